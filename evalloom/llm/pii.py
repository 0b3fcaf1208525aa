"""Personal information in free text, by bootstrapped contextual extraction.

Mentions of four kinds (numbers, names, addresses, e-mail addresses) are proposed by shape; what they are is
learned. A bipartite graph links patterns with instances: patterns are the words left and right of a mention and the
nearest word that says what it is; instances are the forms of numbers and of e-mail addresses, the street words of
addresses and the words of names. Seeds, few and general, carry scores: numbers beside cue words, names after titles,
e-mail addresses with an @ or a bracketed one, listed street words. Spark passes scores from instances to patterns and back for some
rounds, always over the aggregated edges, never over the texts. Patterns that score high then discover what no seed
covers: numbers without a cue, e-mail addresses in words, street words on no list, names without a title; and known
instances are found again in messages written all in capitals or small letters, where shape says nothing. A mention
of any kind counts by the scores of its patterns and its instance alone, and is left out where those for `other` are
higher.

The graph's edges are pre-aggregated on the map side, so a customer or a text that makes up a third of all rows
costs one edge; equal texts are examined once. Texts are read twice: once for mentions and edges, once for names,
when the lexicon is known. Scores reach the mentions by broadcast where their table is measured to be small, and
otherwise by joins on salted keys, with the same result.

Nulls and blank texts have no mentions. A row redelivered gives its mentions once. Positions are code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

# --- fixed values: words by which a mention's neighbourhood is known at the start --------------------------

#: Left neighbours that mark a number of a person, by language; words are compared in small letters.
ID_CUES = {
    "ssn", "social", "security", "insurance", "ni", "passport", "tax", "id", "identity", "itin",
    "steuer-id", "steuernummer", "steuer", "ausweis", "personalausweis", "reisepass", "sozialversicherungsnummer",
    "sécu", "sécurité", "passeport", "fiscal", "dni", "nie", "nif", "pasaporte",
}
PHONE_CUES = {
    "call", "phone", "mobile", "landline", "tel", "reach", "telephone", "cell", "fax", "whatsapp", "telefon", "handy", "rückruf",
    "nummer", "numéro", "téléphone", "rappelez", "teléfono", "móvil", "llame",
}
OTHER_CUES = {
    "order", "invoice", "tracking", "code", "ticket", "serial", "model", "batch", "version", "firmware", "error", "router", "reading",
    "parcel", "part", "sku", "case", "po", "bestellung", "rechnung", "sendung", "modell", "commande", "facture", "colis", "pedido",
    "factura", "envío", "charge", "total", "list", "enthält", "affiche", "muestra", "since", "seit", "depuis", "desde", "shows",
}
#: Left neighbours that mark a person's name.
NAME_SEEDS = {
    "mr", "mrs", "ms", "dr", "herr", "frau", "madame", "monsieur", "mme", "señor", "señora", "sr", "sra",
    "my name is", "i am", "ich heiße", "je m'appelle", "me llamo", "name :", "contact :", "colleague",
}
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "madame", "monsieur", "mme", "mlle", "m", "señor", "señora", "sr", "sra", "don", "doña", "sir"}
PARTICLES = {"von", "van", "de", "der", "den", "del", "della", "di", "da", "la", "le", "du", "zu", "ter", "bin", "al", "el", "y"}
COMPANY = {"ltd", "inc", "llc", "gmbh", "ag", "kg", "sa", "sarl", "sl", "plc", "corp", "co", "company", "group", "&"}
STREETS = "street st road rd lane ln close way avenue ave drive dr court ct square sq terrace crescent boulevard blvd place row hill".split()
STREETS_DE = "straße strasse str weg allee platz gasse ufer ring damm".split()
STREETS_FR = "rue avenue av chemin boulevard bd place allée impasse quai route cours".split()
STREETS_ES = "calle c/ avenida avda av plaza paseo camino carretera ronda".split()

ROUNDS = 4
#: Least mass of a pattern before it may find new instances.
SUPPORT = 3.0
#: A word is a common one if this share of it is written small or starts sentences.
COMMON = 0.93
#: A pattern counts for names from this share of names among what it takes.
PATTERN_FLOOR = 0.6
#: What an e-mail or street address needs from its patterns and its form or street word together; and a street word
#: that is on no list, from the graph alone, over so many patterns.
SURE, OPEN_FLOOR, OPEN_BREADTH = 0.5, 0.5, 4
#: Most rows of a table of scores that is broadcast; larger ones are joined on salted keys.
BROADCAST_ROWS, SALTS = 500_000, 16

# --- tokens and mentions ------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_]))*|\d+|\n|[^\w\s]|_", re.UNICODE)
_EMAIL = re.compile(
    r"(?<![\w.+-])[\w][\w.+-]*(?: ?(?:@|\[at\]|\(at\)|\{at\}) ?| (?:at|AT) (?=[\w-]+ (?:dot|DOT|punkt) ))"
    r"[\w-]+(?:(?:\.| ?(?:\[dot\]|\(dot\)|\{dot\}|\[punkt\]|\(punkt\)) ?| dot | DOT | punkt )[\w-]+)+",
    re.IGNORECASE,
)
_NI = re.compile(r"(?<![\w])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w])", re.IGNORECASE)
_NUMBER = re.compile(
    r"(?<![\w.,/#@:-])(?:[A-Za-z]{1,4}(?=\d))?[+(]?\d[\dA-Za-z]*(?:(?: ?\(0\) ?|\) ?| / |[ ./\-])\(?\d[\dA-Za-z]*)*(?:-[A-Za-z](?![\w]))?(?![\w])"
)
_DIGIT = re.compile(r"\d")


def fold(text: str) -> str:
    """The text with digits and letters of full width made plain; as long as before."""
    if text.isascii() or max(text) <= "\u2000":
        return text
    plain = {ord(ch): unicodedata.normalize("NFKC", ch) for ch in set(text) if ch > "\u2000"}
    return text.translate({code: p for code, p in plain.items() if len(p) == 1})


class Token(NamedTuple):
    text: str
    low: str
    start: int
    end: int


def tokens(text: str) -> list[Token]:
    make = Token._make
    if text.isascii():
        low = text.lower()
        return [make((m[0], low[m.start() : m.end()], *m.span())) for m in _TOKEN.finditer(text)]
    return [make((m[0], m[0].lower().replace("’", "'"), *m.span())) for m in _TOKEN.finditer(text)]


def _mask(token: str) -> str:
    return "<n>" if token.isdigit() else token


def context(words: list[Token], first: int, last: int) -> list[str]:
    """Patterns around words[first..last]: left two, right two, one on each side."""
    left = [_mask(w.low) for w in words[max(0, first - 2) : first]]
    right = [_mask(w.low) for w in words[last + 1 : last + 3]]
    left, right = (["<s>"] + left)[-2:], (right + ["</s>"])[:2]
    return ["l:" + " ".join(left), "r:" + " ".join(right), "b:" + left[-1] + " _ " + right[0]]


def cased(text: str) -> bool:
    """Does the text distinguish capitals from small letters?"""
    return any(c.islower() for c in text) and any(c.isupper() for c in text) and sum(map(str.isupper, text)) < 0.6 * sum(map(str.isalpha, text))


def shape(text: str) -> str:
    """The form of a number: digits as 9, letters as a, exact lengths kept."""
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", text.lower()))


def mail_form(text: str) -> str:
    """The form of an e-mail address: words as a, the signs and words between them kept."""
    form = re.sub(r"[^\W_]+", lambda m: m[0] if m[0] in ("at", "dot", "punkt") else "a", text.lower())
    return re.sub(r"a(?:[._+-]+a)+", "a", form)


def emails(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _EMAIL.finditer(text)]


def numbers(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of long numbers, with a plus or bracket before them, that lie in none of the taken spans."""
    out = []
    busy = list(taken)
    for pattern in (_NI, _NUMBER):
        for m in pattern.finditer(text):
            s, e = m.span()
            if pattern is _NUMBER and s and text[s - 1] in "+(":
                s -= 1
            if sum(c.isdigit() for c in text[s:e]) < 6 or any(s < b and a < e for a, b in busy):
                continue
            busy.append((s, e))
            out.append((s, e))
    return out


_WORD = r"[^\W\d_][\w'’\-]*"
_UNIT = r"(?:flat|unit|apt\.?|apartment|suite|floor|room|studio)\s\w+"
_ADDRESS = [
    re.compile(
        rf"(?<!\w)(?<!\d[ /.-])(?:{_UNIT},\s)?[1-9]\d{{0,4}}\s?[A-Za-z]?(?:-\d+[A-Za-z]?)?,?\s(?:{_WORD}\s){{1,3}}(?P<street>{'|'.join(STREETS)})(?!\w)(?:,\s{_UNIT})?", re.IGNORECASE
    ),
    re.compile(
        rf"(?<!\w)(?:(?:am|an\sder|im|zum|zur)\s)?(?:{_WORD}\s?)?(?P<street>{'|'.join(STREETS_DE)})\.?\s\d+\s?[A-Za-z]?(?!\w)"
        r"(?:,\s(?:hinterhaus|vorderhaus|seitenflügel|\d+\.\s?(?:og|stock|etage)|whg\.?\s?\w+|wohnung\s\w+|eg))?",
        re.IGNORECASE,
    ),
    re.compile(
        rf"(?<!\w)(?<!\d[ /.-])[1-9]\d{{0,4}}[A-Za-z]?(?:\s(?:bis|ter|quater))?,?\s(?P<street>{'|'.join(STREETS_FR)})\s(?:(?:de\sla|des|du|de|d'|l')\s?)?{_WORD}"
        r"(?:,\s(?:appt?\.?|appartement|bât\.?|bâtiment|étage|esc\.?)\s?\w+|,\s\d+\s?(?:er|e|ème)\sétage)?",
        re.IGNORECASE,
    ),
    re.compile(
        rf"(?<!\w)(?P<street>{'|'.join(map(re.escape, STREETS_ES))})\s(?:(?:de\sla|del|de\slos|de)\s)?{_WORD},?\s(?:n[º°]\s?)?\d+[A-Za-z]?(?!\w)"
        r"(?:,\s(?:\d+\s?[º°ª]\s?\w+|piso\s\w+|bajo(?:\s\w+)?|puerta\s\w+|esc\.?\s\w+))*",
        re.IGNORECASE,
    ),
]


#: What every match of a pattern above holds: tried first, since it is found faster.
_HINT = [
    re.compile(rf"\s(?:{'|'.join(STREETS)})(?!\w)", re.IGNORECASE), re.compile(rf"(?:{'|'.join(STREETS_DE)})\.?\s\d", re.IGNORECASE),
    re.compile(rf"\s(?:{'|'.join(STREETS_FR)})\s", re.IGNORECASE), re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, STREETS_ES))})\s", re.IGNORECASE),
]
_CAPITAL = r"[^\W\d_a-zß-öø-ÿ][\w'’\-]+"
#: The same forms around a street word that no list has.
_OPEN = [
    re.compile(rf"(?<!\w)(?<!\d[ /.-])(?:{_UNIT},\s)?[1-9]\d{{0,3}}\s?[A-Za-z]?,?\s(?:{_CAPITAL}\s){{1,2}}(?P<street>{_CAPITAL})(?!\w)(?:,\s{_UNIT})?"),
    re.compile(rf"(?<!\w)(?<!\d[ /.-])[1-9]\d{{0,3}}(?:\s(?:bis|ter))?,?\s(?P<street>[a-zß-öø-ÿ]{{4,}})\s(?:de\sla\s|des\s|du\s|de\s|d'|l'){_CAPITAL}"),
    re.compile(rf"(?<!\w)(?P<street>[^\W\d_]{{4,}})\s(?:de\sla\s|del\s|de\slos\s|de\s){_CAPITAL},?\s[1-9]\d{{0,3}}(?!\w)"),
]


def addresses(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, street word) of what has the form of a street address with a house number and a listed street word."""
    out: list[tuple[int, int, str]] = []
    for hint, pattern in zip(_HINT, _ADDRESS):
        for m in pattern.finditer(text) if hint.search(text) else ():
            s, e = m.span()
            if not any(s < b and a < e for a, b, *_ in [*taken, *out]):
                out.append((s, e, m["street"].lower()))
    return out


def open_addresses(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """The same with any street word: candidates, where capitals tell words apart."""
    out: list[tuple[int, int, str]] = []
    for pattern in _OPEN:
        for m in pattern.finditer(text):
            s, e = m.span()
            if not any(s < b and a < e for a, b, *_ in [*taken, *out]):
                out.append((s, e, m["street"].lower()))
    return out


_INITIAL = re.compile(r"[^\W\d_]\Z")


def _is_name_word(w: Token, keep_case: bool) -> bool:
    return w.text[:1].isupper() and w.text[:1].isalpha() if keep_case else w.text[:1].isalpha()


def name_runs(words: list[Token], text: str, allowed, free: set[int]) -> list[tuple[int, int]]:
    """Runs (first, last word) of words that allowed() takes, with initials and particles between them."""
    runs, i, n = [], 0, len(words)
    gap = lambda a, b: text[words[a].end : words[b].start] == " "
    while i < n:
        if i not in free or not allowed(i):
            i += 1
            continue
        j = i
        while True:
            if j + 1 < n and words[j + 1].text == "." and _INITIAL.match(words[j].text) and j + 2 < n and gap(j + 1, j + 2) and j + 2 in free and allowed(j + 2):
                j += 2
            elif j + 1 < n and j + 1 in free and allowed(j + 1) and gap(j, j + 1):
                j += 1
            elif j + 2 < n and words[j + 1].low in PARTICLES and gap(j, j + 1) and gap(j + 1, j + 2) and j + 2 in free and allowed(j + 2):
                j += 2
            elif (
                j + 3 < n and words[j + 1].low in PARTICLES and words[j + 2].low in PARTICLES and gap(j, j + 1) and gap(j + 1, j + 2) and gap(j + 2, j + 3)
                and j + 3 in free and allowed(j + 3)
            ):
                j += 3
            else:
                break
        runs.append((i, j))
        i = j + 1
    return runs


def _free_words(words: list[Token], taken: list[tuple[int, int]]) -> set[int]:
    if not taken:
        return set(range(len(words)))
    return {i for i, w in enumerate(words) if not any(w.start < b and a < w.end for a, b in taken)}


def mentions(text: str) -> tuple[str, list[Token], list[tuple[int, int]], list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Folded text, its tokens, spans of e-mails, addresses, numbers."""
    plain = fold(text)
    mails = emails(plain)
    digits = _DIGIT.search(plain)
    streets = addresses(plain, mails) if digits else []
    nums = numbers(plain, mails + [(a, b) for a, b, _ in streets]) if digits else []
    return plain, tokens(plain), mails, streets, nums


def _span_words(words: list[Token], s: int, e: int) -> tuple[int, int]:
    inside = [i for i, w in enumerate(words) if w.start < e and s < w.end]
    return (inside[0], inside[-1]) if inside else (0, -1)


def _cue(words: list[Token], first: int, last: int) -> tuple[str | None, str | None]:
    """What the nearest cue word left of a number in its sentence says, and that word; without one, the nearest longer word."""
    near = [w.low for w in words[max(0, first - 6) : first]][::-1]
    nearest = None
    for k, low in enumerate(near):
        if low in ".!?\n" and k and not (low == "." and k + 1 < len(near) and near[k + 1] in ("no", "tel", "nr", "n")):
            break
        for kind, cues in (("id_number", ID_CUES), ("other", OTHER_CUES), ("phone", PHONE_CUES)):
            if low in cues:
                return kind, low
        if nearest is None and len(low) > 3 and low.isalpha():
            nearest = low
    return None, nearest


class Mention(NamedTuple):
    graph: str
    start: int
    end: int
    instance: str
    seed: str | None
    patterns: list[str]


def form_mentions(plain: str, words: list[Token], mails, streets, nums) -> list[Mention]:
    """The mentions that have a form of their own: e-mails, addresses, numbers; with what a seed says of them."""
    out = []
    for s, e in mails:
        a, b = _span_words(words, s, e)
        out.append(Mention("email", s, e, mail_form(plain[s:e]), "email" if re.search(r"@|[\[({]at[\])}]", plain[s:e], re.IGNORECASE) else None, context(words, a, b)))
    busy = mails + nums + [(a, b) for a, b, _ in streets]
    wide = open_addresses(plain, busy) if _DIGIT.search(plain) and cased(plain) else []
    for s, e, street in streets + wide:
        a, b = _span_words(words, s, e)
        company = b + 1 < len(words) and words[b + 1].low in COMPANY
        out.append(Mention("address", s, e, street, "other" if company else "address" if (s, e, street) in streets else None, context(words, a, b)))
    for s, e in nums:
        a, b = _span_words(words, s, e)
        form = shape(plain[s:e])
        seed, cue = _cue(words, a, b)
        if seed is None and (form.startswith("+") or re.fullmatch(r"\(999\) 999-9999", form)):
            seed = "phone"
        out.append(Mention("number", s, e, form, seed, context(words, a, b) + ([f"c:{cue}"] if cue else [])))
    return out


def name_edges(plain: str, words: list[Token], taken: list[tuple[int, int]]) -> Iterator[tuple[str, str, str, str | None]]:
    """(graph, pattern, instance, kind that a seed says): how words are written, and what stands around runs of capitals."""
    if not cased(plain):
        return
    for i, w in enumerate(words):
        if len(w.low) > 1 and w.low[0].isalpha():
            where = "small" if w.text[0].islower() else "first" if not i or words[i - 1].text in ".!?" else "line" if words[i - 1].text in "\n>-:" else "inside"
            yield "case", where, w.low, None
    free = _free_words(words, taken)
    allowed = lambda i: _is_name_word(words[i], True)
    for a, b in name_runs(words, plain, allowed, free):
        before = " ".join(w.low for w in words[max(0, a - 3) : a])
        sentence_start = a == 0 or words[a - 1].text in ".!?\n:>-"
        starts = [a, a + 1] if sentence_start and b > a and words[a + 1].text[:1].isupper() else [a]
        company = any(w.low in COMPANY for w in words[a : b + 2]) or a and words[a - 1].text == "&"
        for start in starts:
            left, right, both = context(words, start, b)
            low = words[start].low
            if start == a and (low in TITLES and b > a or sentence_start and start == b):
                continue
            titled = start > a and words[a].low in TITLES or start and words[start - 1].low in TITLES or start > 1 and words[start - 1].text == "." and words[start - 2].low in TITLES
            introduced = any(before.endswith(s) and (before == s or not before[-len(s) - 1].isalpha()) for s in NAME_SEEDS)
            seed = "other" if company else "name" if titled or introduced and start == a else None
            # A capital at the start of a sentence says nothing, nor does what stands before it.
            if len(low) > 1 and not (sentence_start and start == a):
                yield "name", left, low, seed
                if start == b:
                    yield "name", both, low, seed
            if len(words[b].low) > 1:
                yield "name", right, words[b].low, seed if start == a or titled else None


_SCAN = "row string, tid string, graph string, pattern string, instance string, seed string, n bigint, s int, e int, patterns array<string>, text string, spans array<int>"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One reading of the texts: edges, counted per batch; the mentions with a form; each text with the spans these take."""
    names = [f.split()[0] for f in _SCAN.split(", ")]
    for batch in batches:
        edges: Counter = Counter()
        rows = []
        for tid, text in zip(batch.tid, batch.text):
            plain, words, mails, streets, nums = mentions(text)
            for m in form_mentions(plain, words, mails, streets, nums):
                edges.update((m.graph, p, m.instance, m.seed) for p in m.patterns)
                rows.append(("mention", tid, m.graph, None, m.instance, m.seed, None, m.start, m.end, m.patterns, None, None))
            taken = mails + [(a, b) for a, b, _ in streets] + nums
            edges.update(name_edges(plain, words, taken))
            rows.append(("text", tid, None, None, None, None, None, None, None, None, text, [x for span in taken for x in span]))
        rows += [("edge", None, g, p, i, seed, n, None, None, None, None, None) for (g, p, i, seed), n in edges.items()]
        frame = pd.DataFrame(rows, columns=names, dtype="object")
        yield frame


KINDS = ("phone", "id_number", "email", "address", "name", "other")


def learn(scanned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pattern scores, instance scores (graph, pattern or instance, mass, one score per kind) and the common words."""
    edges = (
        scanned.where(F.col("row") == "edge")
        .groupBy("graph", "pattern", "instance")
        .agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("seed") == k, F.col("n")).otherwise(0)).alias(f"seed_{k}") for k in KINDS])
        # An edge counts by the logarithm of its repeats, so that one hot text can't outvote the rest.
        .withColumn("w", F.log2(F.col("n") + 1.0))
    )
    edges = cut(edges)
    # Words written small, or with a capital only where sentences start, carry no names.
    counted = lambda *where: F.sum(F.when(F.col("pattern").isin(*where), F.col("n")).otherwise(0))
    common = (
        edges.where(F.col("graph") == "case")
        .groupBy("instance")
        .agg(counted("small", "first").alias("plain"), counted("small", "first", "inside").alias("all"))
        .where((F.col("plain") > COMMON * F.col("all")) & (F.col("plain") > 1))
        .select(F.lit("name").alias("graph"), "instance")
    )
    common = cut(common)
    edges = edges.where(F.col("graph") != "case").join(common, ["graph", "instance"], "left_anti")
    edges = cut(edges)
    share = lambda k: F.sum(F.col(f"seed_{k}") / F.col("n") * F.col("w"))
    total = F.sum("w")
    # Where a seed spoke, its share is the floor of an instance's score; one introduction or title makes a name.
    seeds = edges.groupBy("graph", "instance").agg(
        total.alias("mass"),
        *[F.when((F.col("graph") == "name") & F.lit(k == "name"), F.when(F.sum(f"seed_{k}") > 0, 0.9).otherwise(0.0)).otherwise(share(k) / total).alias(k) for k in KINDS],
    )
    seeds = cut(seeds)
    instances = seeds
    floors = seeds.select("graph", "instance", *[F.col(k).alias(f"floor_{k}") for k in KINDS])
    # How far an edge says that its mention is no `other`: a name beside a company's word counts for less.
    clean = lambda k: 1.0 - F.col("seed_other") / F.col("n") if k != "other" else F.lit(1.0)
    seeded = sum((F.col(f"seed_{k}") for k in KINDS), F.lit(0)) / F.col("n")

    def evidence(k: str) -> Column:
        # Beside a cue word a seed's word stands alone; elsewhere it is one voice with the instance's.
        own = F.col(f"seed_{k}") / F.col("n")
        return F.when(F.col("pattern").startswith("c:"), own + (1.0 - seeded) * F.col(k)).otherwise(F.greatest(F.col(k), own) * clean(k))

    for r in range(ROUNDS):
        patterns = (
            edges.join(instances.drop("mass", "breadth"), ["graph", "instance"])
            .groupBy("graph", "pattern")
            .agg(
                total.alias("mass"),
                F.count(F.lit(1)).alias("breadth"),
                *[(F.sum(F.col("w") * evidence(k)) / (total + 0.5)).alias(k) for k in KINDS],
            )
        )
        patterns = cut(patterns)
        # A name is one if any broad pattern that mostly takes names takes it (noisy or); a number's form is what
        # its patterns say on average.
        broad = F.col("breadth") >= SUPPORT + 1
        good, bad = broad & (F.col("name") >= PATTERN_FLOOR), broad & (F.col("name") < 0.5 * PATTERN_FLOOR)
        miss = F.exp(F.sum(F.when(good, F.log(1.0 - 0.9 * F.col("name"))).otherwise(0.0)))
        held = F.sum(F.when(good, F.col("w")).otherwise(0.0))
        named = (1.0 - miss) * held / (held + F.sum(F.when(bad, F.col("w")).otherwise(0.0)) + 0.1)
        mean = lambda k: F.sum(F.col("w") * F.col(k)) / total
        # Words that open a name have their edges to left patterns, words that close one to right patterns.
        opens = F.sum(F.when(F.col("pattern").startswith("l:"), F.col("w")).otherwise(0.0)) / total
        instances = (
            edges.join(patterns.drop("mass"), ["graph", "pattern"])
            .groupBy("graph", "instance")
            .agg(total.alias("m"), F.count(F.lit(1)).alias("breadth"), opens.alias("first"), *[F.when((F.col("graph") == "name") & F.lit(k == "name"), named).otherwise(mean(k)).alias(k) for k in KINDS])
            .join(floors, ["graph", "instance"])
            .select("graph", "instance", F.col("m").alias("mass"), "breadth", "first", *[F.greatest(F.col(k), F.col(f"floor_{k}") * 0.9).alias(k) for k in KINDS])
        )
        instances = cut(instances)
        if r + 1 < ROUNDS:
            instances = instances.drop("first")
    return patterns, instances, common.select(F.col("instance").alias("word"))


# --- decoding ----------------------------------------------------------------------------------------------

#: Least lexicon score of a word that may carry a name, and what a mention needs in all.
WORD_FLOOR, NAME_BOTH, NAME_PATTERN = 0.25, 0.45, 0.8

def _lookup_words(text: str) -> set[str]:
    words = {t.low for t in tokens(fold(text)) if len(t.low) > 1 and t.low[0].isalpha()}
    return words | {p for w in words if "-" in w for p in w.split("-") if len(p) > 1}


def _text_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(tid, w) for tid, text in zip(batch.tid, batch.text) for w in _lookup_words(text)]
        yield pd.DataFrame(rows, columns=["tid", "word"])


_NAMES = "tid string, s int, e int, lex double, n_words int, patterns array<string>"


def _name_rows(tids, texts, spans, lexicons) -> pd.DataFrame:
    rows = []
    for tid, text, taken, lexicon in zip(tids, texts, spans, lexicons):
        pairs = list(zip(taken[0::2], taken[1::2])) if taken is not None else []
        rows += [(tid, s, e, lex, n, patterns) for s, e, lex, n, patterns in name_candidates(text, lexicon, pairs)]
    return pd.DataFrame(rows, columns=["tid", "s", "e", "lex", "n_words", "patterns"])


def _names(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Candidate names of each text, given the lexicon's scores of its words."""
    if lexicon.count() <= BROADCAST_ROWS:
        sent = texts.sparkSession.sparkContext.broadcast({r[0]: (r[1], r[2]) for r in lexicon.select("word", "score", "first").collect()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = sent.value
            for b in batches:
                yield _name_rows(b.tid, b.text, b.spans, [known] * len(b))

        return texts.mapInPandas(run, _NAMES)

    def run_hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _name_rows(b.tid, b.text, b.spans, [{h["word"]: (h["score"], h["first"]) for h in hits} if hits is not None else {} for hits in b.hits])

    words = texts.select("tid", "text").mapInPandas(_text_words, "tid string, word string")
    hits = looked_up(words, lexicon, ["word"], "inner", broadcast=False).groupBy("tid").agg(F.collect_list(F.struct("word", "score", "first")).alias("hits"))
    return texts.join(hits, "tid", "left").select("tid", "text", "spans", "hits").mapInPandas(run_hits, _NAMES)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], how: str, broadcast: bool | None = None) -> DataFrame:
    """rows (with tid) joined to a table of distinct keys: broadcast if it is small, else on keys salted by the text, so that no key is one task's."""
    if broadcast if broadcast is not None else table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, how)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("tid"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"], how).drop("__salt")


def name_candidates(text: str, lexicon: dict[str, tuple[float, float]], taken: list[tuple[int, int]]) -> list[tuple[int, int, float, int, list[str]]]:
    """(start, end, mean lexicon score of the words, number of words, patterns) of the possible names outside the taken spans."""
    plain = fold(text)
    words = tokens(plain)
    free = _free_words(words, taken)
    keep_case = cased(plain)

    def score(i: int) -> float:
        low = words[i].low
        if low in lexicon:
            return lexicon[low][0]
        parts = [p for p in low.split("-") if len(p) > 2]
        return sum(lexicon.get(p, (0.0, 0.5))[0] for p in parts) / len(parts) if "-" in low and parts else 0.0

    initial = lambda i: bool(_INITIAL.match(words[i].text)) and i + 1 < len(words) and words[i + 1].text == "."
    if keep_case:
        allowed = lambda i: _is_name_word(words[i], True) and score(i) >= 0
    else:
        allowed = lambda i: words[i].text[:1].isalpha() and words[i].low not in TITLES and (score(i) >= WORD_FLOOR or initial(i))
    runs = []
    for a, b in name_runs(words, plain, allowed, free):
        if any(w.low in COMPANY for w in words[a : b + 1]) or b + 1 < len(words) and words[b + 1].text == "&" or a and words[a - 1].text == "&":
            continue
        # Two particles may stand between the & of a company and its second name.
        if a > 1 and words[a - 1].low in PARTICLES and (words[a - 2].text == "&" or words[a - 2].low in PARTICLES and a > 2 and words[a - 3].text == "&"):
            continue
        while a < b and (words[a].low in TITLES or words[a].text == "."):
            a += 1
        if words[a].low in TITLES:
            continue
        starts = a == 0 or words[a - 1].text in ".!?\n:>-"
        while a < b and starts and score(a) < WORD_FLOOR and not initial(a) and words[a].text != ".":
            a += 1
            while a < b and (words[a].low in TITLES or words[a].text == "."):
                a += 1
        # After the first two words, one the lexicon doesn't know starts something else.
        known = [k for k in range(a, b + 1) if words[k].text != "." and words[k].low not in PARTICLES and not initial(k)]
        for k in known[2 if keep_case else 1 :]:
            if score(k) < WORD_FLOOR and any(score(j) >= WORD_FLOOR for j in range(a, k)):
                b = k - 1
                break
        while b > a and (words[b].text == "." and not initial(b - 1) or words[b].low in PARTICLES):
            b -= 1
        runs.append((a, b))
    # Family name, comma, given name.
    joined, k = [], 0
    while k < len(runs):
        a, b = runs[k]
        if k + 1 < len(runs):
            c, d = runs[k + 1]
            role = lambda i: lexicon.get(words[i].low, (0.0, 0.5))
            if (
                c == b + 2 and words[b + 1].text == "," and c == d and plain[words[b + 1].end : words[c].start] == " " and plain[words[b].end : words[b + 1].start] == ""
                and role(b)[0] >= WORD_FLOOR and role(c)[0] >= WORD_FLOOR and role(b)[1] < 0.5 <= role(c)[1] and (a == b)
            ):
                joined.append((a, d))
                k += 2
                continue
        joined.append((a, b))
        k += 1
    out = []
    for a, b in joined:
        # A particle before a family name belongs to it.
        while a and words[a - 1].low in PARTICLES - {"y", "la", "le", "el", "al", "de", "du"} and plain[words[a - 1].end : words[a].start] == " " and a - 1 in free:
            a -= 1
        carriers = [i for i in range(a, b + 1) if len(words[i].low) > 1 and words[i].low not in PARTICLES]
        if not carriers:
            continue
        lex = sum(score(i) for i in carriers) / len(carriers)
        left, right, both = context(words, a, b)
        # At the start of a sentence a capital and what stands before it say nothing.
        starts = keep_case and (a == 0 or words[a - 1].text in ".!?")
        patterns = [right] if starts else [left, right, both]
        # What follows a name and a comma is mostly where the person works: only its own words can make it a name.
        if a > 1 and words[a - 1].text == "," and score(a - 2) >= WORD_FLOOR:
            patterns = []
        out.append((words[a].start, words[b].end, lex, len(carriers), patterns))
    return out


def scan(texts: DataFrame) -> DataFrame:
    """What one reading of the distinct texts finds."""
    distinct = texts.select("text").where(F.trim("text") != "").distinct().withColumn("tid", F.md5("text"))
    return cut(spread(distinct).mapInPandas(_scan, _SCAN))


def find(texts: DataFrame) -> DataFrame:
    """(tid, kind, s, e) of the mentions in distinct texts; tid is the text's md5."""
    scanned = scan(texts)
    patterns, instances, common = learn(scanned)
    names = instances.where((F.col("graph") == "name") & (F.col("name") >= WORD_FLOOR))
    lexicon = names.select(F.col("instance").alias("word"), F.col("name").alias("score"), "first")
    lexicon = lexicon.unionAll(common.select("word", F.lit(-1.0), F.lit(0.5)))
    named = cut(_names(scanned.where(F.col("row") == "text").select("tid", "text", "spans"), lexicon))
    formed = scanned.where(F.col("row") == "mention").select("tid", "graph", "s", "e", "instance", F.col("seed").isNull().alias("open"), F.lit(0.0).alias("lex"), F.lit(0).alias("n_words"), "patterns")
    open_ = formed.unionAll(named.select("tid", F.lit("name").alias("graph"), "s", "e", F.lit("").alias("instance"), F.lit(True).alias("open"), "lex", "n_words", "patterns"))
    known = patterns.where((F.col("mass") >= SUPPORT) & ((F.col("graph") != "name") | (F.col("breadth") >= SUPPORT + 1))).drop("mass", "breadth")
    mention = ["tid", "graph", "s", "e", "instance", "open", "lex", "n_words"]
    cue = F.col("pattern").startswith("c:")
    scored = (
        looked_up(open_.select(*mention, F.explode_outer("patterns").alias("pattern")), known, ["graph", "pattern"], "left")
        .groupBy(*mention)
        .agg(
            *[F.avg(F.when(~cue, F.col(k))).alias(f"p_{k}") for k in KINDS], *[F.max(F.when(cue, F.col(k))).alias(f"c_{k}") for k in KINDS],
            F.max("name").alias("best_name"), F.max(F.when(~F.col("pattern").startswith("r:"), F.col("name"))).alias("left_name"),
        )
    )
    forms = instances.where(F.col("graph") != "name").select("graph", "instance", F.col("breadth").alias("i_breadth"), *[F.col(k).alias(f"i_{k}") for k in KINDS])
    scored = looked_up(scored, forms, ["graph", "instance"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = {k: zero(f"p_{k}") + zero(f"i_{k}") + zero(f"c_{k}") for k in KINDS}
    number = (
        F.when((total["other"] >= total["phone"]) & (total["other"] >= total["id_number"]), None)
        .when(total["phone"] >= total["id_number"], "phone")
        .otherwise("id_number")
    )
    is_mail = (total["email"] >= SURE) & (total["email"] > total["other"])
    listed = ~F.col("open") | (zero("i_address") >= OPEN_FLOOR) & (F.col("i_breadth") >= OPEN_BREADTH)
    is_address = listed & (total["address"] >= SURE) & (total["address"] > total["other"])
    is_name = (
        ((F.col("lex") >= NAME_BOTH) & (F.col("n_words") >= 2))
        | ((F.col("lex") >= WORD_FLOOR) & (zero("best_name") >= NAME_BOTH))
        | (zero("left_name") >= NAME_PATTERN)
    )
    graph = F.col("graph")
    kind = F.when(graph == "number", number).when((graph == "email") & is_mail, "email").when((graph == "address") & is_address, "address").when((graph == "name") & is_name, "name")
    return scored.select("tid", kind.alias("kind"), "s", "e").where(F.col("kind").isNotNull())


def pii_mentions(cases: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pii_type, start_pos, end_pos), each once; end exclusive."""
    rows = cases.select(F.col(key), F.col(column).alias("text")).where(F.col("text").isNotNull())
    return (
        rows.select(key, F.md5("text").alias("tid"))
        .distinct()
        .join(find(rows), "tid")
        .select(key, F.col("kind").alias("pii_type"), F.col("s").cast("bigint").alias("start_pos"), F.col("e").cast("bigint").alias("end_pos"))
        .distinct()
    )


def redact(cases: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column) with every mention replaced by <TYPE>, all other text unchanged."""
    rows = cases.select(key, column).distinct().withColumn("__tid", F.md5(column))
    found = find(rows.select(F.col(column).alias("text")).where(F.col("text").isNotNull()))
    spans = found.groupBy(F.col("tid").alias("__tid")).agg(F.sort_array(F.collect_list(F.struct("s", "e", "kind"))).alias("__spans"))

    @F.pandas_udf("string")
    def replace(text: pd.Series, starts: pd.Series, ends: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for t, begins, stops, names in zip(text, starts, ends, kinds):
            if t is not None and begins is not None:
                parts, at = [], 0
                for s, e, kind in zip(begins, stops, names):
                    if s >= at:
                        parts += [t[at:s], f"<{kind.upper()}>"]
                        at = e
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype="object")

    joined = rows.join(spans, "__tid", "left")
    return joined.select(key, replace(F.col(column), F.col("__spans.s"), F.col("__spans.e"), F.col("__spans.kind")).alias(column))
