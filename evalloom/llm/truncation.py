"""Texts cut off by limits, by a prefix self-join of their segments.

A text ends in a segment: a sentence, a list item, a heading, a line of code. If it was cut, the last segment is a
strict prefix of segments that stand whole elsewhere, before another segment or before a full stop. Segments are
compared as token sequences in which numbers, paths, identifiers and codes are masked; every whole segment of the
corpus is broken once into (hash of its first k tokens, next token), and the last segments are joined to these on the
hash, with the cut token matching the next one by its first characters. Whole texts that happen to be prefixes of
other texts are no cases, since their last segments stand whole elsewhere.

A mark after the cut ("[clipped]") or a code block that stays open says itself that a text was cut. Such endings go
through the same join, so that the report says how many of them also have a continuation elsewhere; those whose
segment nobody else wrote are kept by their mark or open block alone.

Sizes: prefixes are rolling hashes of 16 bytes, so a segment of n tokens costs n rows of constant size, be it a
sentence or a file in one line. The node table grows with the distinct segments of the corpus, not with the texts;
a beginning that a third of the texts share is one node per different continuation.

Null and blank texts are whole. Equal texts are examined once per key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

# --- fixed values --------------------------------------------------------------------------------------------

#: Words by which a bracketed note at the end says that something was left out.
MARK_WORDS = "clipped|truncat|cut off|cut here|cut short|omitted|snip|limit|abgeschnitten|gekürzt|tronqu|coup[ée]|cortad|truncad|recortad|more"

_FENCE = re.compile(r"^\s*(?:```|~~~)", re.MULTILINE)
_MARK = re.compile(rf"\s*(?:[\[(<{{]+\s*(?:[^\[\](){{}}<>\n]{{0,60}}(?:{MARK_WORDS})[^\[\](){{}}<>\n]{{0,60}}|\.\.\.|…)\s*[\])>}}]+|(?:-{{2,}}|—)\s*(?:{MARK_WORDS})[^\n]{{0,40}})\s*\Z", re.IGNORECASE)
_DOTS = re.compile(r"\s*(?:\.{3,}|…)\s*\Z")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+|^\s*#{1,6}\s+|^\s*>\s+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+(?=[^\W_a-zß-öø-ÿ]|[\"'“‘(\[`¿¡])", re.UNICODE)
_TOKEN = re.compile(r"(?P<path>[\w-]+(?:/[\w.-]+)*/[\w-]+(?:\.\w+)+)|(?P<id>[^\W\d]\w*_\w+)|(?P<n>\d+(?:[.,:]\d+)*)|(?P<code>(?=\w*\d)(?=\w*[^\W\d])\w+)|[\w/'’-]+|\.{3}|[^\w\s]", re.UNICODE)
END = "<end>"
#: An unstopped ending that so many texts have shows what segments look like.
RECURS = 5


def segment_tokens(segment: str) -> list[str]:
    """The tokens of a segment with numbers, paths, identifiers and codes masked."""
    return [f"<{m.lastgroup}>" if m.lastgroup else m[0] for m in _TOKEN.finditer(_ITEM.sub("", segment, count=1))]


def _prose(text: str) -> tuple[str, bool]:
    """The text without its code blocks, and whether one stays open."""
    parts = _FENCE.split(text)
    if len(parts) % 2 == 0:
        return "\n".join(parts[0::2]), True
    return "\n".join(parts[0::2]), False


def segments(text: str) -> list[str]:
    """Sentences, items and headings of prose, in order."""
    out = []
    for line in text.split("\n"):
        out += [s for s in _SENTENCE.split(line) if s and s.strip()]
    return out


def analyse(text: str) -> tuple[str, list[list[str]], list[str], bool]:
    """(what says itself that the text was cut: mark, code or nothing; whole segments; last segment or []; ended in dots)."""
    body = text.rstrip()
    marked = _MARK.search(body)
    if marked and marked.start():
        body = body[: marked.start()].rstrip()
    prose, open_code = _prose(body)
    found = segments(prose)
    closed = not open_code and re.search(r"(?:```|~~~)\s*\Z", body) is not None
    last: list[str] = []
    dots = False
    if open_code:
        # Code is compared with code: its lines are segments of their own kind.
        *lines, end = _FENCE.split(body)[-1].split("\n")
        last = _code_tokens(end)
    elif found and not closed:
        end = found.pop()
        if _DOTS.search(end):
            end, dots = _DOTS.sub("", end), True
        last = segment_tokens(end)
    whole = [w for w in map(segment_tokens, found) if w]
    for block in _FENCE.split(body)[1::2]:
        whole += [w for w in map(_code_tokens, block.split("\n")[1 : -1 if open_code else None]) if w]
    return "mark" if marked and marked.start() else "code" if open_code else "", whole, last, dots


#: Before the tokens of a line of code.
CODE = "<line>"


def _code_tokens(line: str) -> list[str]:
    found = segment_tokens(line)
    return [CODE, *found] if found else []


def _key(tokens: list[str]) -> str:
    return "\x1f".join(tokens)


def prefix_hashes(tokens: list[str]) -> Iterator[bytes]:
    """Hashes of the first 0, 1, ... n tokens: one pass, whatever the length."""
    rolling = xxhash.xxh3_128()
    yield rolling.digest()
    for t in tokens:
        rolling.update(t.encode("utf-8", "surrogatepass") + b"\x1f")
        yield rolling.digest()


_PIECES = "kind string, tokens string, tid string, dots boolean, says string"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """whole: masked whole segments, each once a batch; last: the last segment of each text, and what the text says itself."""
    for batch in batches:
        whole_keys: dict[str, None] = {}
        rows = []
        for tid, text in zip(batch.tid, batch.text):
            says, whole, last, dots = analyse(text)
            for w in whole:
                whole_keys[_key(w)] = None
            if last or says:
                rows.append(("last", _key(last), tid, dots, says))
                # A last segment with its stop stands whole; its beginnings are beginnings of it.
                if last and not dots and not says and last[-1] in ".!?":
                    whole_keys[_key(last)] = None
        rows += [("whole", k, None, False, "") for k in whole_keys]
        yield pd.DataFrame(rows, columns=["kind", "tokens", "tid", "dots", "says"])


_PROBES = "tokens string, dots boolean, stop boolean, last string, h_all binary, h_head binary"


def _probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct last segments with the hashes of all their tokens and of all but the last."""
    for batch in batches:
        rows = []
        for key, dots in zip(batch.tokens, batch.dots):
            core = key.split("\x1f")
            stop = core[-1] in (".", "!", "?")
            # Before a full stop only a path without its ending tells a cut: "lib/mel." of "lib/mel.py."
            if stop:
                core = core[:-1]
            if core and (not stop or "/" in core[-1]):
                hashes = list(prefix_hashes(core))
                rows.append((key, dots, stop, core[-1], hashes[-1], hashes[-2]))
        yield pd.DataFrame(rows, columns=["tokens", "dots", "stop", "last", "h_all", "h_head"])


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole segments -> (prefix, next token): every way a beginning goes on."""
    for batch in batches:
        seen = set()
        for key, stands in zip(batch.tokens, batch.stands):
            tokens = key.split("\x1f")
            seen.update(zip(prefix_hashes(tokens), [*tokens, END] if stands else tokens))
        yield pd.DataFrame(list(seen), columns=["h", "next"])


def _mask_takes(mask, last):
    """Column: may the cut token `last` be the beginning of something masked?"""
    return (
        F.when(mask == "<path>", last.rlike(r"^[\w-]+(?:/[\w.-]*)*$") & (last != mask))
        .when(mask.isin("<id>", "<code>"), last.rlike(r"^\w+$"))
        .otherwise(F.lit(False))
    )


def examine(texts: DataFrame) -> DataFrame:
    """(tid, says, continued) of the distinct texts that end in a segment or say that they were cut; tid is the text's md5.

    continued: the last segment breaks off where segments elsewhere go on.
    """
    distinct = texts.select("text").where(F.trim("text") != "").distinct().withColumn("tid", F.md5("text"))
    pieces = cut(spread(distinct).mapInPandas(_pieces, _PIECES))
    whole = pieces.where(F.col("kind") == "whole").select("tokens").distinct()
    lasts = pieces.where((F.col("kind") == "last") & (F.col("tokens") != ""))
    probes = lasts.groupBy("tokens", "dots").agg(F.count(F.when(F.col("says") == "", 1)).alias("n_last"))
    # An ending that recurs without a stop shows how segments begin, but not that it stands whole itself.
    shape = F.when(F.col("dots"), F.concat("tokens", F.lit("\x1f..."))).otherwise(F.col("tokens")).alias("tokens")
    recurs = probes.where(F.col("n_last") >= RECURS).select(shape, F.lit(False).alias("stands"))
    sources = whole.select("tokens", F.lit(True).alias("stands")).unionAll(recurs)
    nodes = cut(sources.mapInPandas(_nodes, "h binary, next string").distinct())
    probes = cut(probes.select("tokens", "dots").mapInPandas(_probes, _PROBES))
    # The whole token goes on, or ends here.
    goes_on = (
        probes.select("tokens", "dots", "stop", F.col("h_all").alias("h"))
        .join(nodes, "h")
        .groupBy("tokens", "dots")
        .agg(
            F.max((F.col("next") != END) & ~F.col("next").isin("...") & ~F.col("stop")).alias("extends"),
            F.max(F.col("next") == END).alias("stands"),
            F.max(F.col("next").isin(".", "!", "?")).alias("stops"),
            F.max(~F.col("next").isin(".", "!", "?", "...", END) & ~F.col("stop")).alias("extends_far"),
        )
    )
    # The last token is a beginning of the next one: matched by its first three characters, then in full.
    first = lambda c: F.substring(c, 1, 3)
    literal = nodes.where(~F.col("next").startswith("<")).select("h", "next", F.explode(F.array_distinct(F.array(*[F.substring("next", 1, i) for i in (1, 2, 3)]))).alias("start"))
    masked = nodes.where(F.col("next").startswith("<") & (F.col("next") != END))
    asked = probes.select("tokens", "dots", "stop", "last", F.col("h_head").alias("h"), first("last").alias("start"))
    by_letters = asked.where(~F.col("stop")).join(literal, ["h", "start"]).where(F.col("next").startswith(F.col("last")) & (F.col("next") != F.col("last")))
    by_mask = asked.join(masked, "h").where(_mask_takes(F.col("next"), F.col("last")) & (F.col("next") != F.col("last")))
    partial = by_letters.select("tokens", "dots").unionAll(by_mask.select("tokens", "dots")).distinct().withColumn("partial", F.lit(True))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    judged = probes.select("tokens", "dots").join(goes_on, ["tokens", "dots"], "left").join(partial, ["tokens", "dots"], "left")
    # With dots after it, a sentence that lacks only its stop is whole.
    is_cut = F.when(F.col("dots"), ~no("stands") & ~no("stops") & (no("extends_far") | no("partial"))).otherwise(~no("stands") & (no("extends") | no("partial")))
    cut_keys = judged.where(is_cut).select("tokens", "dots", F.lit(True).alias("continued"))
    ends = pieces.where(F.col("kind") == "last").select("tid", "tokens", "dots", "says").join(cut_keys, ["tokens", "dots"], "left")
    return ends.select("tid", "says", no("continued").alias("continued"))


def cut_texts(texts: DataFrame) -> DataFrame:
    """(tid, evidence) of the distinct texts that were cut: `continued`, `mark and continued`, `mark`, `code and continued` or `code`."""
    says = F.col("says")
    evidence = F.concat_ws(" and ", F.when(says != "", says), F.when(F.col("continued"), "continued"))
    return examine(texts).where((says != "") | F.col("continued")).select("tid", evidence.alias("evidence"))


def outputs(runs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source, text), a redelivered row once."""
    return runs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).distinct()


def cut_runs(runs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source) of the rows whose text was cut."""
    rows = outputs(runs, key, source, text).where(F.col("text").isNotNull())
    found = cut_texts(rows)
    return rows.select("key", "source", F.md5("text").alias("tid")).join(found, "tid", "left_semi").select("key", "source").distinct()


def cut_rates(runs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Per source: texts, cut texts and their share; how many of these a continuation elsewhere shows, and how many only their mark or open code block."""
    rows = outputs(runs, key, source, text).where(F.col("text").isNotNull() & (F.trim("text") != ""))
    rows = cut(rows.select("key", "source", F.md5("text").alias("tid"), "text"))
    was_cut = cut_texts(rows)
    return (
        rows.drop("text")
        .join(was_cut, "tid", "left")
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("n_outputs"), F.count("evidence").alias("n_cut"), F.count(F.when(F.col("evidence").endswith("continued"), 1)).alias("n_continued"),
            F.count(F.when(F.col("evidence").isin("mark", "code"), 1)).alias("n_by_mark_only"),
        )
        .withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_outputs"), 6))
    )
