"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

A text is judged sentence by sentence. A sentence's features are its words, pairs of words and letter n-grams,
hashed into one embedding table; their mean goes through one logistic output per subject. Training runs in
rounds: every partition starts from the same parameters, takes its own steps over its own examples and sends
back what it changed; the changes are averaged (weighted by examples) and sent out again.

The labelled snippets don't cover the vocabulary, so the model then learns from the corpus: a sentence of a
document is labelled by what the model finds in the document's other sentences. Terms of a subject keep its
company and inherit its label; phrases that stand in documents of any subject (remarks, figures of speech,
words of several meanings) get all labels weakly and so none.

Bounds, all parameters: the table has BUCKETS x DIM numbers whatever the data; a training set has at most
TRAIN_ROWS sentences of the corpus, those of documents drawn by a hash from all documents before any is scored, so
that a repeated sentence is in it as often as in the corpus. Their labels are the model's own. Every sentence of every
document is scored, in one pass without a shuffle; there is one output per subject, however many there are.

Null and blank texts have no subject. Sentences inside code blocks, headings and settings are not read as prose.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

BUCKETS, DIM = 1 << 16, 16
#: Partitions that train; the driver receives one table of changes from each.
TRAIN_PARTS = 8
#: Most sentences of a training set drawn from the corpus.
TRAIN_ROWS = 100_000
ROUNDS_FIRST, ROUNDS_NEXT, PASSES = 6, 3, 2
RATE, BATCH = 0.5, 64
#: A sentence has a subject from this probability on.
SENTENCE_FLOOR = 0.35
#: A document is about a subject from this many sentences on.
LEAST_SENTENCES = 2

# --- fixed values -----------------------------------------------------------------------------------------------

#: Second words of company names.
COMPANY_WORDS = "Systems|Foods|Clinics|Rail|Works|Energy|Studios|Labs|Mutual|Logistics|Ltd|Inc|GmbH|AG|Group|Bank|Insurance|Airlines|Partners|Holdings"

_COMPANY_WORD = re.compile(rf" (?:{COMPANY_WORDS})\b")
_COMPANY = re.compile(rf"\b[A-Z][\w'&-]+(?: (?:&|and|und|et|y) [A-Z][\w'-]+)? (?:{COMPANY_WORDS})\b")
_ASIDE = re.compile(r"\s*\((?:(?:see|siehe|voir|véase) )?[^()]{0,60}\)")
_PREFIX = re.compile(r"^\s*(?:[-*>•]+\s*|\d+[.)]\s+|§\s*\d+\s*|\[[^\]]{0,20}\]\s*|[^\W\d_]+(?:\s\[\d+\])?:\s+)+")
_HEADING = re.compile(r"^\s*#{1,6}\s")
_SETTING = re.compile(r"\b\w+=\w+")
_SPLIT = re.compile(r"(?<=[.!?])[\"'”»)]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def sentences(text: str) -> list[str]:
    """The prose sentences of a text, without names of companies, asides, line marks and code."""
    out, code = [], False
    for line in html.unescape(text).split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            code = not code
            continue
        if code or _HEADING.match(line):
            continue
        line = _PREFIX.sub("", " ".join(line.split()))
        # A pattern is tried only where what it needs is there.
        for needed, pattern in ((_COMPANY_WORD.search(line), _COMPANY), ("(" in line, _ASIDE), ("=" in line, _SETTING)):
            if needed:
                line = pattern.sub(" ", line)
        line = " ".join(line.split())
        out += [s for s in _SPLIT.split(line) if _WORD.search(s)]
    return out


class Features:
    """Hashed features of sentences; words are looked up once."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        self.buckets, self.words = buckets, {}

    def _hash(self, text: str) -> int:
        return zlib.crc32(text.encode()) % self.buckets

    def word(self, w: str) -> list[int]:
        if w not in self.words:
            if len(self.words) > 200_000:
                self.words.clear()
            marked = f"<{w}>"
            grams = [self._hash("g" + marked[i : i + n]) for n in (5,) for i in range(len(marked) - n + 1)] if len(w) > 4 else []
            self.words[w] = [self._hash("w" + w)] * 2 + grams
        return self.words[w]

    def split(self, text: str) -> tuple[list[str], list[int]]:
        """A sentence's words, and the ids of its pairs of words."""
        words = [w.lower() for w in _WORD.findall(text)]
        return words, [self._hash(f"b{a} {b}") for a, b in zip(words, words[1:])]

    def sentence(self, text: str) -> list[int]:
        words, pairs = self.split(text)
        return [i for w in words for i in self.word(w)] + pairs

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All feature ids in one array, and where each text's begin."""
        lists = [self.sentence(t) or [0] for t in texts]
        starts = np.zeros(len(lists), np.int64)
        np.cumsum([len(x) for x in lists[:-1]], out=starts[1:])
        return np.fromiter((i for x in lists for i in x), np.int64), starts


class Model:
    """Embedding table, output weights and biases."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.table, self.weights, self.bias = table, weights, bias

    @classmethod
    def fresh(cls, n_labels: int, buckets: int = BUCKETS, dim: int = DIM, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        return cls(rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32), rng.normal(0, 0.5, (dim, n_labels)).astype(np.float32), np.full(n_labels, -2.0, np.float32))

    def mean(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.diff(np.append(starts, len(ids))).astype(np.float32)[:, None]
        return np.add.reduceat(self.table[ids], starts, axis=0) / counts, counts

    def probabilities(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros((0, len(self.bias)), np.float32)
        return 1 / (1 + np.exp(-np.clip(self.mean(ids, starts)[0] @ self.weights + self.bias, -30, 30)))

    def train(self, ids: np.ndarray, starts: np.ndarray, targets: np.ndarray, passes: int, seed: int, rate: float = RATE) -> None:
        """Steps of adaptive gradient descent over shuffled batches; targets are probabilities."""
        rng = np.random.default_rng(seed)
        ends = np.append(starts[1:], len(ids))
        slow_t = np.full(len(self.table), 1e-3, np.float32)
        slow_w = np.full_like(self.weights, 1e-3)
        slow_b = np.full_like(self.bias, 1e-3)
        for _ in range(passes):
            order = rng.permutation(len(starts))
            for lo in range(0, len(order), BATCH):
                rows = order[lo : lo + BATCH]
                counts = ends[rows] - starts[rows]
                at = np.zeros(len(rows), np.int64)
                np.cumsum(counts[:-1], out=at[1:])
                own = np.concatenate([ids[starts[r] : ends[r]] for r in rows])
                hidden, n = self.mean(own, at)
                p = 1 / (1 + np.exp(-np.clip(hidden @ self.weights + self.bias, -30, 30)))
                error = p - targets[rows]
                to_hidden = (error @ self.weights.T) / n
                gw, gb = hidden.T @ error / len(rows), error.mean(axis=0)
                slow_w += gw * gw
                slow_b += gb * gb
                self.weights -= rate * 0.2 * gw / np.sqrt(slow_w)
                self.bias -= rate * 0.2 * gb / np.sqrt(slow_b)
                unique, back = np.unique(own, return_inverse=True)
                grad = np.zeros((len(unique), self.table.shape[1]), np.float32)
                np.add.at(grad, back, np.repeat(to_hidden, counts, axis=0))
                slow_t[unique] += (grad * grad).mean(axis=1)
                self.table[unique] -= rate * grad / np.sqrt(slow_t[unique])[:, None]

    def change_since(self, before: tuple[np.ndarray, ...]) -> dict[str, bytes]:
        """What training changed: the rows of the table that moved, with half precision, and the output layer."""
        moved = np.flatnonzero(np.any(self.table != before[0], axis=1)).astype(np.int32)
        rows = (self.table[moved] - before[0][moved]).astype(np.float16)
        layer = np.concatenate([(self.weights - before[1]).ravel(), self.bias - before[2]]).astype(np.float32)
        return {"moved": moved.tobytes(), "rows": rows.tobytes(), "layer": layer.tobytes()}


class Scorer:
    """A model's probabilities for many sentences: equal ones once, and each word's embeddings summed once."""

    #: Words whose sums are kept.
    KEPT = 100_000

    def __init__(self, model: Model) -> None:
        self.model, self.features = model, Features(len(model.table))
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.sums = np.zeros((1024, self.model.table.shape[1]), np.float32)
        self.sizes = np.zeros(1024, np.float32)

    def _word(self, w: str) -> int:
        at = self.known.get(w)
        if at is None:
            at = self.known[w] = len(self.known)
            if at == len(self.sums):
                self.sums, self.sizes = np.concatenate([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            ids = self.features.word(w)
            self.sums[at], self.sizes[at] = self.model.table[ids].sum(axis=0), len(ids)
        return at

    def of(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(self.model.bias)), np.float32)
        if len(self.known) > self.KEPT:
            self._reset()
        places: dict[str, int] = {}
        at = [places.setdefault(t, len(places)) for t in texts]
        words, pairs, n_words, n_pairs = [], [], [], []
        for t in places:
            own, ids = self.features.split(t)
            words += [self._word(w) for w in own]
            pairs += ids
            n_words.append(len(own))
            n_pairs.append(len(ids))
        total, size = self._gather(self.sums, words, n_words), self._gather(self.sizes[:, None], words, n_words)
        total += self._gather(self.model.table, pairs, n_pairs)
        size += np.array(n_pairs, np.float32)[:, None]
        hidden = total / np.maximum(size, 1)
        p = 1 / (1 + np.exp(-np.clip(hidden @ self.model.weights + self.model.bias, -30, 30)))
        return p[at]

    @staticmethod
    def _gather(rows: np.ndarray, ids: list[int], counts: list[int]) -> np.ndarray:
        """Sums of the rows of each text; texts may have none."""
        out = np.zeros((len(counts), rows.shape[1]), np.float32)
        n = np.array(counts, np.int64)
        some = np.flatnonzero(n)
        if len(some):
            starts = np.cumsum(n) - n
            out[some] = np.add.reduceat(rows[np.array(ids, np.int64)], starts[some], axis=0)
        return out


def fit(rows: DataFrame, model: Model, rounds: int, passes: int = PASSES, parts: int = TRAIN_PARTS) -> Model:
    """Train on rows (text, target array<float>): rounds of local steps, changes averaged between rounds."""
    spark = rows.sparkSession
    rows = cut(rows.select("text", "target").repartition(parts))
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((model.table, model.weights, model.bias))

        def steps(batches: Iterator[pd.DataFrame], sent=sent, r=r) -> Iterator[pd.DataFrame]:
            frames = [b for b in batches if len(b)]
            if not frames:
                return
            pdf = pd.concat(frames, ignore_index=True)
            before = sent.value
            own = Model(*[x.copy() for x in before])
            ids, starts = Features(len(own.table)).rows(pdf.text.tolist())
            own.train(ids, starts, np.stack(pdf.target.to_numpy()).astype(np.float32), passes, seed=r)
            yield pd.DataFrame([{"n": len(pdf), **own.change_since(before)}])

        changes = rows.mapInPandas(steps, "n bigint, moved binary, rows binary, layer binary").collect()
        # A feature that few partitions saw moves as those moved it, not less for the others' silence.
        table, touched, total = np.zeros_like(model.table), np.zeros(len(model.table), np.float32), 0
        layer = np.zeros(model.weights.size + model.bias.size, np.float32)
        for c in changes:
            moved = np.frombuffer(c["moved"], np.int32)
            table[moved] += np.frombuffer(c["rows"], np.float16).reshape(len(moved), -1).astype(np.float32) * c["n"]
            touched[moved] += c["n"]
            layer += np.frombuffer(c["layer"], np.float32) * c["n"]
            total += c["n"]
        if not total:
            break
        layer /= total
        model.weights += layer[: model.weights.size].reshape(model.weights.shape)
        model.bias += layer[model.weights.size :]
        model.table += table / np.maximum(touched, 1)[:, None]
        sent.unpersist()
    return model


def example_rows(examples: DataFrame, subjects: list[str]) -> DataFrame:
    """Sentences of the labelled snippets and their snippets' subjects, as targets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, [float(k == x) for k in subjects]) for t, x in zip(b.text, b.subject) if t is not None for s in sentences(t)]
            yield pd.DataFrame(rows, columns=["text", "target"])

    return examples.where(F.col("subject").isin(subjects)).select("text", "subject").mapInPandas(run, "text string, target array<float>")


def sentence_count(documents: DataFrame) -> int:
    """Sentences of the documents that have more than one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = [len(sentences(text)) for text in b.text]
            yield pd.DataFrame({"n": [sum(n for n in counts if n > 1)]})

    return spread(documents.select("text")).mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0


#: Documents, about, from which the sentences of all are estimated.
COUNTED = 4_000


def _place() -> Column:
    """A document's place in the order of a draw, from 0 to 2**32."""
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 32))


def estimated_sentences(documents: DataFrame) -> int:
    """About how many sentences the documents have: their characters by those of a sentence in a drawn part."""
    size = F.length("text").cast("bigint")
    n, chars = documents.agg(F.count(F.lit(1)), F.sum(size)).first()
    share = min(1.0, COUNTED / max(n, 1))
    drawn = documents.where(_place() < int(share * (1 << 32))) if share < 1 else documents
    seen = drawn.agg(F.sum(size)).first()[0] or 1
    return max(1, round(sentence_count(drawn) * (chars or 0) / seen))


def company_rows(documents: DataFrame, model: Model, n_sentences: int, train_rows: int, sharpen: bool) -> DataFrame:
    """At most train_rows of the corpus' n_sentences sentences, with what the model finds in their documents' other sentences.

    Documents are drawn first and only they are scored; sentences beyond the bound are those of the documents drawn last.
    """
    sent = documents.sparkSession.sparkContext.broadcast((model.table, model.weights, model.bias))
    cutoff = min(1 << 32, (train_rows << 32) // max(n_sentences, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Model(*sent.value))
        for b in batches:
            split = [sentences(text) for text in b.text]
            scores = scorer.of([s for parts in split for s in parts])
            rows, end = [], 0
            for place, parts in zip(b.place, split):
                p, end = scores[end : end + len(parts)], end + len(parts)
                if len(parts) < 2:
                    continue
                best = p.max(axis=1)
                sure = best >= SENTENCE_FLOOR
                held = np.where(sure[:, None], p / p.sum(axis=1, keepdims=True) * best[:, None], 0)
                total = held.sum(axis=0)
                for i, s in enumerate(parts):
                    others = total - held[i]
                    weight = others.sum()
                    if weight < 0.5:
                        continue
                    target = others / weight
                    if sharpen and sure[i]:
                        mixed = p[i] * (0.05 + target)
                        target = 0.5 * target + 0.5 * mixed / mixed.sum() * min(1.0, best[i] * 1.5)
                    elif sharpen:
                        target = target * 0.5
                    rows.append((s, target.tolist(), place))
            yield pd.DataFrame(rows, columns=["text", "target", "place"])

    drawn = documents.select("text", _place().alias("place")).where(F.col("place") < F.lit(cutoff))
    rows = spread(drawn).mapInPandas(run, "text string, target array<float>, place bigint")
    # The draw meets its share only about; what lies beyond the bound is left out.
    return (rows if n_sentences <= train_rows else rows.orderBy("place", "text").limit(train_rows)).select("text", "target")


def learn(documents: DataFrame, examples: DataFrame, subjects: list[str], train_rows: int = TRAIN_ROWS) -> Model:
    """The model for the subjects, from the snippets and then twice from the corpus."""
    labelled = cut(example_rows(examples, subjects))
    model = fit(labelled, Model.fresh(len(subjects)), ROUNDS_FIRST, passes=6, parts=2)
    documents = documents.where(F.col("text").isNotNull())
    n_sentences = estimated_sentences(documents)
    for again in (False, True):
        rows = company_rows(documents, model, n_sentences, train_rows, again)
        model = fit(rows.unionAll(labelled), Model.fresh(len(subjects)) if not again else model, ROUNDS_NEXT)
    return model


def document_subjects(p: np.ndarray) -> list[int]:
    """Subjects of a document from its sentences' probabilities."""
    if not len(p):
        return []
    best, top = p.argmax(axis=1), p.max(axis=1)
    counts = np.bincount(best[top >= SENTENCE_FLOOR], minlength=p.shape[1])
    if counts.sum() == 1:
        return [int(counts.argmax())]
    return [int(k) for k in np.flatnonzero(counts >= LEAST_SENTENCES)]


def classify(documents: DataFrame, examples: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject) for every document and subject that it is about."""
    names = [r[0] for r in subjects.select("subject").where(F.col("subject").isNotNull()).distinct().orderBy("subject").collect()]
    if not names:
        return documents.select("doc_id", F.lit("").alias("subject")).limit(0)
    model = learn(documents, examples, names)
    sent = documents.sparkSession.sparkContext.broadcast((model.table, model.weights, model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(Model(*sent.value))
        for b in batches:
            split = [sentences(text) for text in b.text]
            scores = scorer.of([s for parts in split for s in parts])
            rows, end = [], 0
            for doc, parts in zip(b.doc_id, split):
                p, end = scores[end : end + len(parts)], end + len(parts)
                rows += [(doc, names[k]) for k in document_subjects(p)]
            yield pd.DataFrame(rows, columns=["doc_id", "subject"])

    # Ids travel as text: pandas would make numbers with nulls among them floating.
    texts = spread(documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return texts.mapInPandas(run, "doc_id string, subject string").select(F.col("doc_id").cast("bigint").alias("doc_id"), "subject")


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Per subject: documents about it, and their share of all documents with a text."""
    total = documents.where(F.trim("text") != "").agg(F.count(F.lit(1)).alias("n_all"))
    counts = found.groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"))
    n = total.first()[0]
    return counts.withColumn("share", F.round(F.col("n_documents") / F.lit(max(n, 1)), 6))
