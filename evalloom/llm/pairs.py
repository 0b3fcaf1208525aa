"""Broken prompt and response pairs, each with the first defect that applies.

A pair is judged on its own, in one pass over the rows after the join to the question: a suffix automaton of the
question's words measures how much of the answer is copied from it, a phrase automaton finds refusals in
several languages, a delimiter stack finds structures left open, and stopwords vote for languages. Responses are
JSON envelopes around a content of verdicts; the rationales of the verdicts are judged like answers.

Nulls: a pair whose question is null or blank is no case; a null answer is `empty`. Repeated rows count once.
Texts of any length are read whole, in time proportional to their length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# --- fixed values: phrases and words by language ---------------------------------------------------------------

#: What refusals say, in small letters; first person or policy, so that reports of others' refusals don't match.
REFUSALS = [
    "i can't help", "i cannot help", "can't help with that", "cannot help with that", "i can't assist", "i cannot assist", "i can't answer", "i cannot answer",
    "unable to comply", "i am unable to", "i'm unable to", "i am not able to", "i'm not able to", "i won't be able to", "i will not be able to",
    "must decline", "have to decline", "i decline", "i'd rather not", "i would rather not", "i cannot provide", "i can't provide", "i cannot discuss", "i can't discuss",
    "off limits for me", "guidelines do not allow", "guidelines don't allow", "no answer can be given", "i'm permitted to", "i am permitted to", "i am not permitted",
    "i'm not permitted", "i am not allowed", "i'm not allowed", "must refrain", "against the rules i", "i do not feel comfortable", "i don't feel comfortable",
    "i'm not comfortable", "i am not comfortable", "ask a human expert", "i refuse", "i cannot judge", "i can't judge", "i cannot comply", "i can't comply", "i cannot comment",
    "kann ich nicht helfen", "kann ich leider nicht", "ich kann nicht", "ich kann dabei nicht", "kann ich keine", "darf ich leider nicht", "darf ich nicht", "ich darf nicht",
    "möchte ich mich nicht", "möchte ich nicht", "muss ich ablehnen", "muss ich diese", "muss ich leider", "ich muss ablehnen", "ich lehne", "nicht gestattet, ", "ist mir nicht",
    "je ne peux pas", "je ne peux malheureusement", "je ne suis pas en mesure", "je ne suis pas autoris", "ne m'est pas autoris", "ne m'est pas permis", "il m'est impossible",
    "je dois malheureusement", "je dois décliner", "je préfère ne pas", "je refuse", "je regrette de ne",
    "no puedo ayudar", "no puedo dar", "no puedo responder", "no puedo contestar", "no puedo proporcionar", "debo rechazar", "debo declinar", "no me está permitido",
    "no me es posible", "prefiero no", "no estoy autorizad", "me niego",
    "não posso", "prefiro não", "devo recusar", "non posso", "preferisco non", "devo rifiutare",
]
#: How sentences begin that come with a refusal or an answer and say nothing themselves.
FILLERS = (
    "hello", "hi", "hey", "thank", "thanks", "regarding your question", "please", "sorry", "apologies", "i'm sorry", "i am sorry", "my apologies", "unfortunately",
    "as an assistant", "hallo", "danke", "guten", "bitte", "leider", "es tut mir leid", "bonjour", "merci", "désolé", "je suis désolé", "veuillez", "hola", "gracias",
    "lo siento", "por favor", "lamentablemente", "olá", "obrigad", "desculpe",
)
#: Stand-ins for no answer.
STAND_INS = {
    "", "null", "none", "nil", "nan", "na", "n a", "no answer", "not available", "no response", "answer", "response", "tbd", "todo", "undefined", "unknown", "empty",
    "antwort", "keine antwort", "keine angabe", "k a", "réponse", "sans réponse", "pas de réponse", "respuesta", "sin respuesta", "s o", "a", "json", "text", "hello", "hi",
    "blank", "missing",
}
#: Frequent words that are not names, by language.
STOPWORDS = {
    "en": "the of and to in is was were are be been for on with that this it its by from at as or but not no yes an which who what when where why how did does do only also than after their them they there here has have had about years year out into more most first",
    "de": "der die das den dem des und in im ist war wurde wurden werden sind für auf mit dass dieser diese dieses es von vom zu zur zum bei als oder aber nicht kein keine ja ein eine einen einem einer welche welches wer was wann wo warum wie nur auch nach sich hier hat haben über jahr aus mehr denn daher beide ihre nahm nennt steht wird man weil davon rund",
    "fr": "le la les l un une des du de et à au aux en est était a été sont pour sur avec que qui ce cette ces il elle on par dans ou mais ne pas oui non quel quelle quand où pourquoi comment combien seulement aussi après se s ici ont plus d c y leur tous deux donc sans surtout",
    "es": "el la los las un una unos unas de del y a al en es fue era son para con que este esta esto estos lo se por o pero no sí qué quién cuándo cuánto cuánta cuántas dónde cómo solo también después su sus aquí ha han más sin así ya según la fueron como nombran",
    "pt": "o a os as um uma de do da dos das e em no na nos nas ao à às é foi era são para com que este esta isto se por pela pelo ou mas não sim quem quando quanto onde só também depois seu sua aqui há mais sem assim já foram",
    "it": "il lo la i gli le un una di del della e in nel nella al alla è era sono stato stata per con che questo questa si da dal dalla o ma non sì quale chi quando quanto dove perché come solo anche dopo suo sua qui ha hanno più senza così",
    "nl": "de het een en van in is was werd zijn voor op met dat die dit niet geen ja nee wie wat wanneer waar waarom hoe alleen ook na door bij als of maar uit meer naar om er deze",
    "pl": "i w na z do jest był była są dla się że to nie tak kto co kiedy gdzie dlaczego jak tylko po przez lub ale o od oraz",
    "sv": "och i att det som en ett är var för på med av den till inte om ett har hade men från vid också efter",
}
_STOP = {lang: frozenset(words.split()) for lang, words in STOPWORDS.items()}
#: Words that label a repeated question.
LABELS = {"q", "question", "frage", "pregunta", "prompt", "a", "answer"}

_WORD = re.compile(r"[^\W_]+", re.UNICODE)
_CITATION = re.compile(r"\[\s*cite_?\d*\s*\]?")
_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»')
_HIDDEN = re.compile(r"[​-‏⁠﻿­]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_FENCE = re.compile(r"^\s*```[\w-]*[ \t]*\n?(.*?)(\n?```\s*)?\Z", re.DOTALL)


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class SuffixAutomaton:
    """All substrings of a word sequence; match() gives the longest suffix that occurs at each position of another."""

    def __init__(self, sequence: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in sequence:
            now = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[now] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[now] = clone
            last = now

    def match(self, sequence: list[str]) -> list[int]:
        state, run, out = 0, 0, []
        for w in sequence:
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state, run = self.next[state][w], run + 1
            else:
                state, run = 0, 0
            out.append(run)
        return out


@lru_cache(maxsize=4096)
def automaton(question: str) -> tuple[SuffixAutomaton, int]:
    sequence = words(question)
    return SuffixAutomaton(sequence), len(sequence)


def copied(question: str, answer: str) -> tuple[list[bool], int]:
    """Which words of the answer lie in a run copied from the question, and the longest run."""
    machine, n = automaton(question)
    sequence = words(answer)
    runs = machine.match(sequence)
    least = min(4, n)
    # A run that grows marks its words one by one after its first `least`.
    marks = [False] * len(sequence)
    for i, r in enumerate(runs):
        if r >= least:
            for k in range(i - r + 1, i + 1) if r == least else (i,):
                marks[k] = True
    return marks, max(runs, default=0)


def is_copy(question: str, answer: str) -> bool:
    """Does the answer repeat the question, the whole of it, and nothing else?"""
    n = automaton(question)[1]
    marks, longest = copied(question, answer)
    left = [w for w, m in zip(words(answer), marks) if not m and w not in LABELS]
    return n > 0 and not left and longest >= max(1, round(0.8 * n))


@lru_cache(maxsize=1)
def refusal_automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase in REFUSALS:
        machine.add_word(phrase, phrase)
    machine.make_automaton()
    return machine


def is_refusal(answer: str) -> bool:
    """Does the answer decline, with nothing in it that answers? What is quoted was said by others."""
    text = _QUOTED.sub(" ", answer.replace("’", "'")).lower()
    refused = False
    for sentence in _SENTENCE.split(text):
        sentence = sentence.strip()
        if not words(sentence):
            continue
        if next(refusal_automaton().iter(sentence), None) is not None:
            refused = True
        elif not sentence.startswith(FILLERS):
            return False
    return refused


def language(text: str, skip: list[bool] | None = None) -> str | None:
    """The language with most stopwords in the text, if it has at least two and clearly most."""
    votes = dict.fromkeys(_STOP, 0)
    for i, w in enumerate(words(text)):
        if skip is None or i >= len(skip) or not skip[i]:
            for lang, stop in _STOP.items():
                votes[lang] += w in stop
    first, second = sorted(votes.items(), key=lambda v: -v[1])[:2]
    return first[0] if first[1] >= 2 and first[1] > second[1] else None


def bare(text: str) -> str:
    """The words of a text that aren't marks, citations or fences."""
    text = _CITATION.sub(" ", _HIDDEN.sub("", text)).replace("```", " ")
    return " ".join(words(text))


def is_empty(text: str | None) -> bool:
    return text is None or bare(text) in STAND_INS


_CLOSERS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}


def open_delimiters(text: str) -> bool:
    """Does a bracket, quotation or code block stay open at the end?"""
    if text.count("```") % 2:
        return True
    stack: list[str] = []
    for ch in text:
        if ch in "([{“«":
            stack.append(ch)
        elif ch in _CLOSERS and stack and stack[-1] == _CLOSERS[ch]:
            stack.pop()
        elif ch == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            else:
                stack.append(ch)
    return bool(stack)


def is_truncated(question: str, answer: str) -> bool:
    """Does the answer stop in mid-word, mid-sentence or mid-structure? Short answers and items need no full stop."""
    text = _HIDDEN.sub("", answer).rstrip()
    if open_delimiters(text):
        return True
    line = text.rpartition("\n")[2]
    if re.match(r"\s*(?:[-*•]|\d+[.)])(?:\s|\Z)", line):
        item = re.sub(r"^\s*(?:[-*•]|\d+[.)])\s*", "", line)
        tail = item.rpartition(" ")[2]
        known = set(_WORD.findall(question)) | set(_WORD.findall(text[: len(text) - len(line)]))
        return not item or tail not in known and any(k.startswith(tail) and k != tail for k in known)
    core = text.rstrip("\"'”’»)]}`* ")
    if core.endswith((".", "!", "?", "…", "。", ":")):
        return False
    fragment = _CITATION.sub("", _SENTENCE.split(text)[-1]).strip()
    if fragment != _CITATION.sub("", text).strip():
        return bool(fragment)
    spoken = fragment.split()
    if len(spoken) > 4:
        return True
    # Names and numbers make short answers; a sentence of a few words with a small last word was begun.
    return len(spoken) > 1 and spoken[-1][:1].islower() and spoken[0][:1].isupper() and not re.match(r"\d", spoken[0])


def answer_defect(question: str, answer: str | None) -> str | None:
    if is_empty(answer):
        return "empty"
    if is_refusal(answer):
        return "refusal"
    if is_copy(question, answer):
        return "copy"
    if other_language(question, answer):
        return "other_language"
    if is_truncated(question, answer):
        return "truncated"
    return None


def other_language(question: str, answer: str) -> bool:
    """Is the answer's own part, without quotations and what it copies, in another language than the question?"""
    text = _QUOTED.sub(" ", answer)
    mine, theirs = language(text, copied(question, text)[0]), language(question)
    return mine is not None and theirs is not None and mine != theirs


VERDICT_KEYS = ("relevance_label", "support_label", "citation_label")
_BROKEN = object()


def response_content(response: str | None):
    """The content text of a chat completion; None if there is none, _BROKEN if the response's own text breaks off."""
    if response is None or not response.strip():
        return None
    try:
        envelope = json.loads(response)
    except (ValueError, RecursionError):
        return _BROKEN if response.lstrip()[:1] in "{[\"" else response
    if not isinstance(envelope, dict):
        return envelope if isinstance(envelope, str) else None
    choices = envelope.get("choices")
    first = choices[0] if isinstance(choices, list) and choices else None
    message = first.get("message") if isinstance(first, dict) else None
    content = message.get("content") if isinstance(message, dict) else message
    if isinstance(content, list):
        content = "".join(p.get("text") or "" if isinstance(p, dict) else p if isinstance(p, str) else "" for p in content)
    if isinstance(content, dict):
        return json.dumps(content, ensure_ascii=False)
    return content if isinstance(content, str) else None


def content_value(content: str):
    """(decoded JSON, text before it) of a content, fenced or after an introduction; the text itself if it holds none."""
    fenced = _FENCE.match(content)
    inner = fenced[1] if fenced else content
    if fenced and fenced[2] is None:
        return _BROKEN
    try:
        return json.loads(inner)
    except (ValueError, RecursionError):
        pass
    at = min((i for i in (inner.find("{"), inner.find("[{")) if i >= 0), default=-1)
    if at < 0:
        return content
    try:
        value, _ = json.JSONDecoder().raw_decode(inner[at:])
    except (ValueError, RecursionError):
        return _BROKEN
    return content if open_delimiters(content[:at].replace('"', "")) and content.count("```") % 2 else value


def verdicts(value) -> list[dict]:
    if isinstance(value, dict):
        value = value["citations"] if "citations" in value else [value]
    if isinstance(value, dict):
        value = [value]
    return [v for v in value if isinstance(v, dict)] if isinstance(value, list) else []


def response_defect(question: str, response: str | None) -> str | None:
    content = response_content(response)
    if content is _BROKEN:
        return "truncated"
    if content is None or is_empty(content):
        return "empty"
    value = content_value(content)
    if value is _BROKEN:
        return "truncated"
    if isinstance(value, str):
        # Plain text: no verdict, unless it declines, repeats the question, or breaks off.
        if is_empty(value):
            return "empty"
        found = answer_defect(question, value)
        return found or "empty"
    given = verdicts(value)
    reasons = [v["rationale"] for v in given if isinstance(v.get("rationale"), str) and not is_empty(v["rationale"])]
    judged = any(v.get(k) is not None for v in given for k in VERDICT_KEYS)
    if not judged and not reasons:
        return "empty"
    if reasons and all(is_refusal(r) for r in reasons):
        return "refusal"
    if reasons and all(is_copy(question, r) for r in reasons):
        return "copy"
    if reasons and all(other_language(question, r) for r in reasons):
        return "other_language"
    if any(is_truncated(question, r) for r in reasons):
        return "truncated"
    return None


FOUND = "source_table string, sample_id string, passage_id string, defect string"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # Redelivered pairs stand together after the join; those that don't are one row of the result all the same.
        batch = batch.drop_duplicates()
        defects = [
            answer_defect(q, a) if t == "garage_fixture" else response_defect(q, a) for t, q, a in zip(batch.source_table, batch.question, batch.answer)
        ]
        out = batch[["source_table", "sample_id", "passage_id"]].assign(defect=defects)
        yield out[out.defect.notna()]


def defective_pairs(fixture: DataFrame, small: DataFrame, large: DataFrame) -> DataFrame:
    """(source_table, sample_id, passage_id, defect) of the defective pairs, each once."""
    asked = fixture.where(F.col("question").isNotNull() & F.col("question").rlike(r"\S"))
    questions = asked.select("sample_id", "question").distinct()
    own = asked.select(
        F.lit("garage_fixture").alias("source_table"), "sample_id", F.lit("").alias("passage_id"), "question", F.col("answer_generate").alias("answer")
    )
    lesser = small.select(F.lit("small_responses").alias("source_table"), "sample_id", F.coalesce("passage_id", F.lit("")).alias("passage_id"), F.col("small_response").alias("answer"))
    greater = large.select(F.lit("large_responses").alias("source_table"), "sample_id", F.lit("").alias("passage_id"), F.col("large_response").alias("answer"))
    # The answers are shuffled once, to their questions; that rows count once is left to the small result.
    replies = lesser.unionAll(greater).join(questions, "sample_id")
    columns = ["source_table", "sample_id", "passage_id", "question", "answer"]
    return spread(own).select(columns).unionAll(replies.select(columns)).mapInPandas(_judge, FOUND).distinct()
