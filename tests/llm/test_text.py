"""The text problems against brute force, round trips and odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import mixing, packing, pairs, percentiles, pii, subjects, tokens, truncation

# --- pairs --------------------------------------------------------------------------------------------------------

Q = "Which product did Norlio Foods withdraw in 1992?"


@pytest.mark.parametrize(
    "answer, defect",
    [
        (None, "empty"), ("  ", "empty"), ("[cite_1]", "empty"), ("N/A", "empty"), ("```\n```", "empty"), ("​", "empty"),
        ("I'm sorry, but I can't help with that request.", "refusal"), ("Diese Frage darf ich leider nicht beantworten.", "refusal"), ("Lo siento, no puedo ayudar con esa solicitud.", "refusal"),
        (Q, "copy"), ("which  product did norlio foods withdraw in 1992", "copy"), (f'Q: "{Q}"', "copy"), (f"{Q} {Q}", "copy"),
        ("Im Jahr 1992 nahm Norlio Foods den OrbiGrid nach mehreren Beschwerden vom Markt [cite_1].", "other_language"),
        ("In 1992 the company withdrew the OrbiGrid after sev", "truncated"), ("In 1992 it withdrew the OrbiGrid [cit", "truncated"), ("It withdrew this. The rea", "truncated"),
        ("OrbiGrid Mini", None), ("1992", None), ("In 1992 the company withdrew the OrbiGrid Mini after several complaints [cite_3].", None),
        (f"{Q} In 1992 the company withdrew the OrbiGrid after several complaints [cite_3].", None),
        ('Norlio told reporters "I cannot help with that" and gave no reason. It withdrew the OrbiGrid [cite_1].', None),
        ("It withdrew the OrbiGrid after the complaints [cite_1].\n- Ashby\n- OrbiGrid", None),
    ],
)
def test_answers(answer, defect):
    assert pairs.answer_defect(Q, answer) == defect


@pytest.mark.parametrize(
    "content, defect",
    [
        (None, "empty"), ('"{\\"citations\\": []}"', "empty"), ('"{\\"relevance_label\\": null}"', "empty"), ('"I must decline."', "refusal"),
        ('"{\\"relevance_label\\": \\"relevant\\", \\"rationale\\": \\"The text names the product and the year.\\"}"', None),
        ('"```json\\n{\\"relevance_label\\": \\"relevant\\"}\\n```"', None), ('"Here is my verdict:\\n{\\"relevance_label\\": \\"r\\"}"', None), ('"{\\"relevance_label\\": \\"rel"', "truncated"),
        ('"{\\"relevance_label\\": \\"r\\", \\"rationale\\": \\"The text names the prod\\"}"', "truncated"),
        ('"{\\"relevance_label\\": null, \\"rationale\\": \\"I must decline.\\"}"', "refusal"), ('[{"type": "text", "text": "n/a"}]', "empty"),
    ],
)
def test_responses(content, defect):
    response = None if content is None else '{"choices": [{"message": {"content": %s}}]}' % content
    assert pairs.response_defect(Q, response) == defect
    assert pairs.response_defect(Q, '{"choices": [{"message": {"content": "{\\"a') == "truncated"


def test_automaton_against_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(1, 9))] for _ in range(2))
        want = [max((k for k in range(i + 2) if any(a[j : j + k] == b[i + 1 - k : i + 1] for j in range(len(a)))), default=0) for i in range(len(b))]
        assert pairs.SuffixAutomaton(a).match(b) == want


def test_pairs_on_tables(spark):
    fixture = spark.createDataFrame([("s", Q, None), ("s", Q, None), ("t", " ", None), (None, None, "x")], "sample_id string, question string, answer_generate string")
    small = spark.createDataFrame([("s", "p", None), ("gone", "p", None)], "sample_id string, passage_id string, small_response string")
    large = spark.createDataFrame([], "sample_id string, large_response string")
    rows = {tuple(r) for r in pairs.defective_pairs(fixture, small, large).collect()}
    assert rows == {("garage_fixture", "s", "", "empty"), ("small_responses", "s", "p", "empty")}


# --- truncation ---------------------------------------------------------------------------------------------------

WHOLE = "Checked 7 rows by hand.\n- kept the old default\nThe owner of src/a.py asked me to wait.\n```\ncode(1)\n```\nAll is well."


def test_truncation(spark):
    texts = [WHOLE] * 3 + [WHOLE.replace("7", "9") + " See src/b.py"] + ["Checked 5 rows by hand.\n- kept the old default", "All is well..."]
    cut = ["Checked 8 rows by ha", "All is well.\n- kept the o", "All is well. The owner of src/a", "All is well.\n```\ncode(", "Checked 3 rows.\n[output clipped]", "All is well. The owner of lib/x.ts asked…"]
    odd = [None, "", "   ", "word " * 20_000 + "end."]
    rows = [(str(i), "h", t) for i, t in enumerate(texts + cut + odd)] + [("0", "h", WHOLE)]
    df = spark.createDataFrame(rows, "run string, harness string, out string")
    got = {r.key for r in truncation.cut_runs(df, "run", "harness", "out").collect()}
    assert got == {str(len(texts) + i) for i in range(len(cut))}
    rate = truncation.cut_rates(df, "run", "harness", "out").first()
    assert (rate.n_outputs, rate.n_cut) == (len(texts) + len(cut) + 1, len(cut))
    assert truncation.cut_runs(df.limit(0), "run", "harness", "out").collect() == []


# --- percentiles --------------------------------------------------------------------------------------------------


def test_percentiles_hold_their_bound(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.exponential(500, 30_000), np.full(10_000, 7)]).astype(int)
    rows = spark.createDataFrame([(f"{i:032x}", "a", i % 3, int(v)) for i, v in enumerate(values)] + [("n", "nulls", 0, None)], "id string, g string, d int, v bigint")
    rows = rows.unionAll(rows.limit(5000))
    days = percentiles.sketches(rows, ["g", "d"], F.col("v"), "id", k=400)
    merged = percentiles.merge(days, ["g"], k=400)
    out = {r["rank"]: r for r in percentiles.percentiles(merged, k=400).collect()}
    ordered = np.sort(values)
    assert out[0.5].n == len(values)
    for rank, r in out.items():
        low, high = np.searchsorted(ordered, r.value, "left") / len(ordered), np.searchsorted(ordered, r.value, "right") / len(ordered)
        bound = percentiles.rank_error(400)
        assert low - bound <= rank <= high + bound
        assert r.least <= r.value <= r.most
    assert percentiles.percentiles(merged.limit(0)).collect() == []


# --- packing ------------------------------------------------------------------------------------------------------


def documents(spark, texts):
    return spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "doc_id bigint, text string, source string")


def test_packing_places_every_token_once(spark):
    texts = [("word " * (3 + i * 7 % 60), ["a", "A ", "b-c"][i % 3]) for i in range(300)] + [("long " * 500, "a"), (None, "a"), ("", "b c"), ("x", None)]
    docs, boxes = documents(spark, texts), spark.createDataFrame([("small", 64), ("large", 300), ("none", 0)], "container_name string, capacity_tokens int")
    packed = packing.pack(docs, boxes).toPandas()
    size = {r.doc_id: r.tokens for r in packing.sizes(docs).collect()}
    for name, capacity in (("small", 64), ("large", 300)):
        mine = packed[packed.container_name == name]
        assert mine.groupby("doc_id").tokens.sum().to_dict() == size
        assert mine.groupby(["shard", "container_no"]).tokens.sum().max() <= capacity
        pieces = mine[mine.piece > 0].doc_id.unique()
        assert all(size[d] > capacity for d in pieces)
        boxes_used = len(mine.groupby(["shard", "container_no"]))
        assert boxes_used <= 1.03 * sum(size.values()) / capacity + 2
    assert set(packed.container_name) == {"small", "large"}
    assert packing.pack(docs.limit(0), boxes).collect() == [] and packing.pack(docs, boxes.limit(0)).collect() == []


def test_nulls_ties_and_clashing_names(spark):
    rows = [(i if i % 3 else None, "same text" if i % 2 else f"text {i}", "a" if i % 5 else None, i, "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int, shard string")
    boxes = spark.createDataFrame([("b", 16, 1)], "container_name string, capacity_tokens int, tokens int")
    packed = packing.pack(docs, boxes).toPandas()
    assert packed.tokens.sum() == packing.sizes(docs).agg(F.sum("tokens")).first()[0] and packed.doc_id.isna().sum() == 14
    assert packed.groupby(["shard", "container_no"]).tokens.sum().max() <= 16
    targets = spark.createDataFrame([("a", 1.0, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    assert mixing.select(docs, targets).agg(F.max("uses")).first()[0] == 1


def test_windows_are_mixed():
    items = [(i, "ab"[i % 4 == 0], 10) for i in range(4000)]
    rows = list(packing.fill(items, 400, {"b": 0.25, "a": 0.75}, {}))
    per = {}
    for window, *_, doc, _, _, tokens in rows:
        per.setdefault(window, []).append(tokens * (doc % 4 == 0))
    assert all(abs(sum(v) - 100) <= 20 for v in list(per.values())[:-1])


# --- mixing -------------------------------------------------------------------------------------------------------


def test_flow_against_brute_force():
    targets = {"a": mixing.Target(0.5, 1), "b": mixing.Target(0.5, 3)}
    flows, total = mixing.route({("a",): 60, ("a", "b"): 60, ("b",): 10}, targets)
    # b alone has 30 at most; each text of both may go either way, three times in all.
    assert total == max(t for t in range(1, 400) if t // 2 <= 120 and t // 2 <= 210 and 2 * (t // 2) <= 60 + 180 + 30)
    assert sum(v for (_, s), v in flows.items() if s == "a") == total // 2
    small, size = mixing.route({("a",): 100, ("b",): 100}, targets, 100)
    assert size == 100 and small == {(("a",), "a"): 50, (("b",), "b"): 50}


def test_mix_meets_shares_and_caps(spark):
    texts = [(f"text number {i} of this source", ["alpha", "Beta", "beta "][min(i % 5, 2)]) for i in range(3000)] + [("shared text here", "alpha"), ("shared text here", "beta"), (None, "alpha"), ("", "beta")]
    docs = documents(spark, texts)
    targets = spark.createDataFrame([("alpha", 0.6, 3), ("beta", 0.4, 1), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    chosen = mixing.select(docs, targets)
    rep = {r.source: r for r in mixing.report(chosen, targets).collect()}
    assert abs(rep["alpha"].actual_share - 0.6) < 0.01 and rep["alpha"].most_uses <= 3 and rep["beta"].most_uses <= 1 and rep["none"].n_tokens == 0
    assert chosen.groupBy("doc_id").count().where("count > 1").count() == 0
    assert {tuple(r) for r in chosen.collect()} == {tuple(r) for r in mixing.select(docs, targets).collect()}
    assert mixing.select(docs.limit(0), targets).collect() == []


# --- subjects -----------------------------------------------------------------------------------------------------


def test_training_set_holds_its_bound_and_copies_are_drawn_apart(spark):
    docs = [(i, "The soup was cold. " + " ".join(f"Word{i} x{k}." for k in range(4))) for i in range(60)] + [(60, "One alone."), (61, None)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string").where("text is not null")
    assert subjects.sentence_count(documents) == 300
    sure = subjects.Model(np.zeros((1 << 10, 8), np.float32), np.zeros((8, 2), np.float32), np.array([3.0, -3.0], np.float32))
    rows = subjects.company_rows(documents, sure, 300, 100, False).collect()
    copies = sum(r.text == "The soup was cold." for r in rows)
    assert 75 < len(rows) <= 100 and 5 < copies < 40
    assert len(subjects.company_rows(documents, sure, 300, 7, False).collect()) <= 7
    assert len(subjects.company_rows(documents, sure, 300, 300, False).collect()) == 300



def test_gradient_step_lowers_the_loss():
    features, model = subjects.Features(1 << 10), subjects.Model.fresh(2, 1 << 10, 8)
    ids, starts = features.rows(["the cup final was decided late", "bread needs salt and flour"] * 20)
    wanted = np.array([[1, 0], [0, 1]] * 20, np.float32)
    before = np.abs(model.probabilities(ids, starts) - wanted).mean()
    model.train(ids, starts, wanted, passes=20, seed=1)
    assert np.abs(model.probabilities(ids, starts) - wanted).mean() < 0.2 < before


def test_document_rule():
    p = lambda *rows: np.array(rows, np.float32)
    assert subjects.document_subjects(p([0.9, 0.1], [0.8, 0.1], [0.1, 0.9])) == [0]
    assert subjects.document_subjects(p([0.1, 0.9], [0.1, 0.1])) == [1]
    assert subjects.document_subjects(p([0.9, 0.1], [0.1, 0.9])) == []
    assert subjects.document_subjects(np.zeros((0, 2))) == []


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(0)
    words = {"sport": "goal striker referee league cup relay sprint coach".split(), "food": "bread soup oven salt stew bakery cheese flour".split()}
    sentence = lambda s: f"The {rng.choice(words[s])} was near the {rng.choice(words[s])} and the {rng.choice(words[s])}."
    examples = spark.createDataFrame([(s, " ".join(sentence(s) for _ in range(2))) for s in words for _ in range(25)], "subject string, text string")
    truth = [("sport", "food")[i % 2] for i in range(60)]
    docs = [(i, " ".join([*[sentence(s) for _ in range(3)], "The reply was polite."])) for i, s in enumerate(truth)] + [(900, None), (901, " "), (902, "x " * 5000), (None, "x.")]
    found = subjects.classify(
        spark.createDataFrame(docs, "doc_id bigint, text string"), examples, spark.createDataFrame([("sport",), ("food",)], "subject string")
    ).collect()
    right = sum((i, s) in {(r.doc_id, r.subject) for r in found} for i, s in enumerate(truth))
    assert right >= 55 and len(found) <= 66 and not {900, 901} & {r.doc_id for r in found}


def test_sentences_leave_out_what_is_not_prose():
    text = "# Head\nCustomer: The soup (see Kelvia Energy) was cold. [cite_1] Fine.\n```\ncode here\n```\n- Norlio Foods closed. label=x"
    assert subjects.sentences(text) == ["The soup was cold.", "[cite_1] Fine.", "closed."]


# --- personal information -----------------------------------------------------------------------------------------

NAMES = ["Rosa Osvick", "Milo Tarmann", "Hana Pellaro", "Goran Melquist", "Petra Doreira", "Yara Fenlow"]


@pytest.fixture(scope="module")
def messages():
    rows = []
    for i, n in enumerate(NAMES * 4):
        first, last = n.split()
        rows += [
            f"My name is {n} and I wait.", f"Mr {last} promised a call.", f"My colleague {n} opened the ticket.", f"Thanks, {first}", f"Ask for {first} at the desk.",
            f"Call me back on +1 202 555 01{i:02d} after 9:15.", f"My mobile is 202-555-01{i:02d}.", f"SSN 987-65-43{i:02d} is on file.", f"Model 987-65-43{i:02d} is out of stock.",
            f"Where is order 145-2452{i:03d}-7724237?", f"Deliver to {n}, {i + 3} Kirbrook Rd.", f"Invoice INV-2026-786{i:02d} shows 12.50 twice.", "The grace period ended. Will the fix come in May?",
        ]
    return rows


def test_personal_information(spark, messages):
    extra = [
        "Write to rosa.osvick [at] post [dot] example [dot] net, please.", "The reset mail went to x***@*** today.", "thanks, rosa osvick", "THANKS, HANA PELLARO", None, "", " ",
        "Our address is still Flat 2, 37 Broton Close.", "The Marlwood Lane lamp flickers.", "Zoë said hi 😀 to a@b.example. Then left.", "a" * 50_000,
    ]
    rows = list(enumerate(messages + extra))
    df = spark.createDataFrame([(str(i), t) for i, t in rows] + [("0", messages[0])], "id string, msg string")
    got = {(r.id, r.pii_type, rows[int(r.id)][1][r.start_pos : r.end_pos]) for r in pii.pii_mentions(df, "id", "msg").collect()}
    n = len(messages)
    assert (str(n), "email", "rosa.osvick [at] post [dot] example [dot] net") in got and (str(n + 9), "email", "a@b.example") in got
    assert (str(n + 7), "address", "Flat 2, 37 Broton Close") in got and (str(n + 2), "name", "rosa osvick") in got and (str(n + 3), "name", "HANA PELLARO") in got
    assert not [g for g in got if g[0] in {str(n + k) for k in (1, 4, 5, 6, 8, 10)}]
    for i, text in rows[:13]:
        kinds = {g[1:] for g in got if g[0] == str(i)}
        want = {
            0: {("name", "Rosa Osvick")}, 1: {("name", "Osvick")}, 2: {("name", "Rosa Osvick")}, 3: {("name", "Rosa")}, 4: {("name", "Rosa")}, 5: {("phone", "+1 202 555 0100")},
            6: {("phone", "202-555-0100")}, 7: {("id_number", "987-65-4300")}, 8: set(), 9: set(), 10: {("name", "Rosa Osvick"), ("address", "3 Kirbrook Rd")}, 11: set(), 12: set(),
        }[i]
        assert kinds == want, (text, kinds)


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([("1", "Mail a@b.example, or 12 Kirbrook Rd."), ("2", None)], "id string, msg string")
    assert {tuple(r) for r in pii.redact(df, "id", "msg").collect()} == {("1", "Mail <EMAIL>, or <ADDRESS>."), ("2", None)}


def test_token_counts_match_the_tokenizer(spark):
    texts = ["Hello world", "äöü 😀", "", "<|endoftext|>", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokens.count_tokens("t").alias("n")).orderBy("i").collect()
    encode = tokens.encoding(tokens.VOCABULARY).encode_ordinary
    assert [r.n for r in rows] == [None if t is None else len(encode(t)) for t in texts]
