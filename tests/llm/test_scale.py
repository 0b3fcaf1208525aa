"""Rules of the text operators that matter at scale: discovery by the graph, long lines, mixtures, bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import mixing, packing, percentiles, pii, subjects, truncation

# --- personal information -----------------------------------------------------------------------------------------


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, msg string")
    return {(r.id, r.pii_type, texts[r.id][r.start_pos : r.end_pos]) for r in pii.pii_mentions(df, "id", "msg").collect()}


@pytest.fixture(scope="module")
def corpus():
    out = []
    for i in range(40):
        out += [f"Please deliver it to {i + 2} Kirbrook Road, before noon.", f"We moved to {i + 3} Oldwin Street, so update that.", f"Parcels go to {i + 5} Tarn Lane, as before."]
        out += [f"Write to user{i}@mail.example when it is done.", f"My e-mail is a.b{i}@post.example, use that.", f"The call cost {i + 2} Blue Credits, before tax.", f"It was {i + 1} Star Service, as before."]
    return out


def test_addresses_and_mails_are_decided_by_the_graph(spark, corpus):
    extra = [
        "Please deliver it to 14 Oldwin Mews, before noon.", "We moved to 9 Kirbrook Mews, so update that.", "Parcels go to 31 Tarn Mews, as before.", "Please deliver it to 77 Arden Mews, before noon.",
        "Write to rosa at mail dot example when it is done.", "It was 3 Star Service, as before.", "The call cost 9 Blue Credits, before tax.",
    ]
    found = spans(spark, corpus + extra)
    n = len(corpus)
    # A street word on no list is learned from the patterns that listed ones share with it; other capitals aren't.
    assert {(n, "address", "14 Oldwin Mews"), (n + 1, "address", "9 Kirbrook Mews"), (n + 2, "address", "31 Tarn Mews")} <= found
    assert (n + 4, "email", "rosa at mail dot example") in found
    assert not [f for f in found if f[0] in (n + 5, n + 6)]


def test_cue_words_are_patterns_of_the_graph():
    plain, words, mails, streets, nums = pii.mentions("Please note my passport number 555-44-9988 for this.")
    (m,) = pii.form_mentions(plain, words, mails, streets, nums)
    assert m.seed == "id_number" and "c:passport" in m.patterns


def test_broadcast_and_salted_lookups_agree(spark, corpus, monkeypatch):
    texts = corpus + ["Mr Rosa Osvick called.", "My name is Rosa Osvick.", "Frau Osvick bat um Rückruf.", "thanks, rosa osvick"] * 3
    one = spans(spark, texts)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", -1)
    assert spans(spark, texts) == one


def test_hints_change_no_match():
    import re

    for hint, pattern in zip(pii._HINT, pii._ADDRESS):
        for text in ("12 Kirbrook Rd", "im Lindenweg 4, 2. OG", "Am Ring 12", "12 rue de la Paix", "3 bis, quai Voltaire", "Calle Mayor 12, 3º B", "C/ Sol, 5", "Hauptstr. 9", "no street"):
            assert not re.search(pattern, text) or hint.search(text), (pattern, text)


# --- truncation ---------------------------------------------------------------------------------------------------


def test_a_line_of_100000_tokens(spark):
    long = " ".join(f"w{i % 977}x" if i % 3 else "word" for i in range(100_000))
    words = long.split(" ")
    texts = [long + " and more.", long + " and mo", "A short text.", " ".join(words[:60_000]), "A sho"]
    df = spark.createDataFrame([(str(i), "h", t) for i, t in enumerate(texts)], "run string, harness string, out string")
    assert {r.key for r in truncation.cut_runs(df, "run", "harness", "out").collect()} == {"1", "3", "4"}


def test_prefix_hashes_are_those_of_the_prefixes():
    tokens = ["a", "b\x1e", "", "ab", "ü"]
    assert [list(truncation.prefix_hashes(tokens[:k]))[-1] for k in range(6)] == list(truncation.prefix_hashes(tokens))


def test_marked_and_open_endings_go_through_the_join(spark):
    whole = "The run ended well. All tests are green today.\n```\nreturn total + 1\n```\nDone."
    texts = [whole] * 2 + ["The run ended well. All tests are gre [output clipped]", "The run ended well. Nobody else wrote thi [output clipped]", "Done.\n```\nreturn tot", "Done.\n```\nunseen cod", "Done.\n```\nreturn total + 1\n```"]
    df = spark.createDataFrame([(str(i), "h", t) for i, t in enumerate(texts)], "run string, harness string, out string")
    rows = df.select(F.col("out").alias("text")).distinct()
    by = {r.tid: r.evidence for r in truncation.cut_texts(rows).collect()}
    ids = {r.text: r.tid for r in rows.select("text", F.md5("text").alias("tid")).collect()}
    assert [by.get(ids[t]) for t in texts] == [None, None, "mark and continued", "mark", "code and continued", "code", None]
    rate = truncation.cut_rates(df, "run", "harness", "out").first()
    assert (rate.n_outputs, rate.n_cut, rate.n_continued, rate.n_by_mark_only) == (7, 4, 2, 2)


# --- percentiles --------------------------------------------------------------------------------------------------


def test_fractional_values_keep_their_fractions(spark):
    rows = spark.createDataFrame([("a", x) for x in (0.2, 0.4, 0.9, float("nan"), None)], "g string, v double")
    parts = percentiles.sketches(rows, ["g"], F.col("v"))
    out = {r["rank"]: r.value for r in percentiles.percentiles(percentiles.merge(parts, ["g"])).collect()}
    assert out[0.5] == 0.4 and out[0.01] == 0.2 and out[0.999] == 0.9


# --- packing ------------------------------------------------------------------------------------------------------


def test_runs_of_windows_meet_the_proportions():
    rng = np.random.default_rng(4)
    items = [(i, "abcd"[min(3, i % 7)], int(rng.integers(20, [120, 300, 500, 60][min(3, i % 7)]))) for i in range(4000)]
    size = {s: sum(t for _, x, t in items if x == s) for s in "abcd"}
    shares = {s: t / sum(size.values()) for s, t in size.items()}
    items.sort(key=lambda x: x[2])
    windows = {}
    of = {i: s for i, s, _ in items}
    for w, _, doc, _, _, tokens in packing.fill(items, 1000, shares, {}):
        windows.setdefault(w, dict.fromkeys("abcd", 0))[of[doc]] += tokens
    assert sum(map(sum, (w.values() for w in windows.values()))) / (1000 * len(windows)) > 0.98
    runs = [{s: sum(windows[k][s] for k in range(i, i + 8)) for s in "abcd"} for i in range(0, len(windows) - 16, 8)]
    far = [sum(abs(v / sum(r.values()) - shares[s]) for s, v in r.items()) / 2 for r in runs]
    assert np.mean(far) < 0.05


def test_mixture_report_against_brute_force(spark):
    texts = [("word " * (5 + i * 3 % 40), "ab"[i % 3 == 0]) for i in range(200)]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "doc_id bigint, text string, source string")
    boxes = spark.createDataFrame([("b", 64)], "container_name string, capacity_tokens int")
    packed = packing.pack(docs, boxes)
    row = packing.mixture(packed, docs, boxes).first()
    pdf = packed.toPandas().assign(source=lambda d: d.doc_id.map(lambda i: texts[i][1]))
    share = pdf.groupby("source").tokens.sum() / pdf.tokens.sum()
    per = pdf.pivot_table(index=["shard", "container_no"], columns="source", values="tokens", aggfunc="sum").fillna(0)
    far = ((per.div(per.sum(axis=1), axis=0) - share).clip(lower=0)).sum(axis=1)
    assert abs(row.mean_distance - far.mean()) < 1e-3 and row.n_windows == len(per) and row.least_distance <= row.mean_distance


def test_running_sums_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 7)
    rows = spark.createDataFrame([("ab"[i % 2], i, float(i % 5)) for i in range(100)], "k string, o int, v double")
    got = {(r.k, r.o): r.c for r in packing.running_sum(rows, "k", "o", "v", "c").collect()}
    assert all(got["ab"[i % 2], i] == sum(float(j % 5) for j in range(i % 2, i, 2)) for i in range(100))


def test_mixed_selections_are_packed_as_often_as_used(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (1 + i % 4), "a" if i % 4 else "b") for i in range(400)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    boxes = spark.createDataFrame([("x", 128)], "container_name string, capacity_tokens int")
    chosen = mixing.select(docs, targets)
    uses = chosen.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), "uses"))).drop("col")
    packed = packing.pack_sized(uses, boxes, targets)
    assert packed.agg(F.sum("tokens")).first()[0] == chosen.agg(F.sum(F.col("tokens") * F.col("uses"))).first()[0]
    assert packing.mixture(packed, chosen.select("doc_id", "source").distinct(), boxes, targets).first().mean_run_distance < 0.1


# --- subjects -----------------------------------------------------------------------------------------------------


def test_a_sentence_in_a_third_of_the_documents_keeps_the_bound(spark):
    docs = [(i, ("The soup was cold. " if i % 3 == 0 else "") + " ".join(f"Word{i} x{k} is here." for k in range(5))) for i in range(3000)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert abs(subjects.estimated_sentences(documents) - 16_000) < 800
    sure = subjects.Model(np.zeros((1 << 10, 8), np.float32), np.zeros((8, 2), np.float32), np.array([3.0, -3.0], np.float32))
    rows = subjects.company_rows(documents, sure, subjects.estimated_sentences(documents), 1000, False).collect()
    assert 800 < len(rows) <= 1000 and 30 < sum(r.text == "The soup was cold." for r in rows) < 110


def test_scores_are_those_of_the_model():
    model, texts = subjects.Model.fresh(3, 1 << 10, 8), ["the cup final", "the cup final", "bread needs salt", "", "7 8", "one"]
    assert np.abs(subjects.Scorer(model).of(texts)[[0, 2, 5]] - model.probabilities(*subjects.Features(1 << 10).rows([texts[0], texts[2], texts[5]]))).max() < 1e-6
    assert subjects.Scorer(model).of([]).shape == (0, 3)
