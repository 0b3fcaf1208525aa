"""Rows that fail to parse: bulk-parse blocks, bisect the failing ones, diagnose single records strictly.

A block of records takes a columnar path: one Arrow CSV parse of the whole block plus vectorised checks that
the block holds nothing Arrow reads more leniently than the format allows. A block that fails is halved, and
its halves take the same path again, until the bad records are isolated; only they and their few neighbours
meet the strict scanner that names the reason. The work is one pass over the rows in whatever partitions they have, so neither a hot
file nor a hot key matters; only the header lookup moves data.

Nulls: a null or blank value is missing, not bad; a null or empty line is no record.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .strict_json import fast_value, is_object

#: One finite decimal number in ASCII digits, spaces around it allowed.
NUMBER = r"^ *[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)? *$"
_NUMBER = re.compile(NUMBER.replace("$", r"\Z"))
#: Failing blocks are halved down to LEAST_BLOCK records, which are scanned one by one. Blocks double while they
#: pass, up to MOST_BLOCK, and shrink where bad rows are dense.
LEAST_BLOCK, MOST_BLOCK = 8, 8192


def good_number(text: str) -> bool:
    """A decimal number whose value is finite."""
    return bool(_NUMBER.match(text)) and abs(float(text)) != float("inf")


def split_record(line: str, delimiter: str) -> tuple[list[str] | None, str | None]:
    """The fields of one record, or the reason why there are none; `""` inside quotes is one quote."""
    fields, i, n = [], 0, len(line)
    while True:
        if line[i : i + 1] == '"':
            parts, i = [], i + 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None, "broken_quoting"
                parts.append(line[i:j])
                i = j + 1
                if line[i : i + 1] != '"':
                    break
                parts.append('"')
                i += 1
            if i < n and line[i] != delimiter:
                return None, "broken_quoting"
            fields.append("".join(parts))
        else:
            j = line.find(delimiter, i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return None, "broken_quoting"
            fields.append(line[i:j])
            i = j
        if i >= n:
            return fields, None
        i += 1
        if i == n:
            fields.append("")
            return fields, None


def _all_numbers(values: pa.Array) -> bool:
    kept = values.filter(pc.fill_null(pc.not_equal(pc.utf8_trim_whitespace(values), ""), False))
    if not len(kept):
        return True
    if not pc.all(pc.match_substring_regex(kept, NUMBER)).as_py():
        return False
    # Arrow's cast knows neither a leading plus nor a bare point at the end.
    plain = pc.replace_substring_regex(pc.utf8_trim(kept, " "), r"^([+-]?)([0-9]+)\.($|[eE])", r"\1\2\3")
    plain = pc.replace_substring_regex(plain, r"^\+", "")
    plain = pc.replace_substring_regex(plain, r"^(-?)\.", r"\10.")
    try:
        return bool(pc.all(pc.is_finite(pc.cast(plain, pa.float64()))).as_py())
    except pa.ArrowInvalid:
        return False


def _all_objects(values: pa.Array) -> bool:
    """One parse of all values; a marker between them, unguessable to the data, shows that none reached over its end."""
    kept = [v for v in values.to_pylist() if v is not None and v.strip()]
    if not kept:
        return True
    mark = uuid.uuid4().hex
    marks = [f"{mark}{i}" for i in range(len(kept))]
    text = "[" + ",".join(f'{v},"{m}"' for v, m in zip(kept, marks)) + "]"
    try:
        parsed = fast_value(text)
    except (ValueError, RecursionError):
        return False
    return len(parsed) == 2 * len(kept) and parsed[1::2] == marks and all(isinstance(v, dict) for v in parsed[::2])


def _value_reason(score: str | None, payload: str | None) -> str | None:
    if score is not None and score.strip() and not good_number(score):
        return "bad_score"
    if payload is not None and payload.strip() and not is_object(payload):
        return "bad_payload"
    return None


def bisect(n: int, bulk: Callable[[int, int], bool], single: Callable[[int], None]) -> None:
    """Blocks of rows 0..n that bulk() accepts are done; others are halved until few are left, each given to single()."""
    at, size = 0, 512
    while at < n:
        end = min(at + size, n)
        stack, failed = [(at, end)], 0
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= LEAST_BLOCK:
                # A bulk parse costs as much as the strict scan of so few records.
                for i in range(lo, hi):
                    single(i)
            elif not bulk(lo, hi):
                failed += 1
                mid = (lo + hi) // 2
                stack += [(mid, hi), (lo, mid)]
        at = end
        size = min(size * 2, MOST_BLOCK) if not failed else max(4 * LEAST_BLOCK, size // 2 if failed > 4 else size)


def _text(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.string())


def _values_batches(score: bool, payload: bool):
    """mapInArrow function over (key, score, payload): adds the reason, null for a valid row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _text(batch.column("__score")) if score else pa.nulls(len(batch), pa.string())
            payloads = _text(batch.column("__payload")) if payload else pa.nulls(len(batch), pa.string())
            reasons: list[str | None] = [None] * len(batch)

            def bulk(lo: int, hi: int) -> bool:
                return _all_numbers(scores.slice(lo, hi - lo)) and _all_objects(payloads.slice(lo, hi - lo))

            def single(i: int) -> None:
                reasons[i] = _value_reason(scores[i].as_py(), payloads[i].as_py())

            bisect(len(batch), bulk, single)
            yield batch.drop_columns(["__score", "__payload"]).append_column("__reason", pa.array(reasons, pa.string()))

    return run


def judge_values(df: DataFrame, score_col: str | None, payload_col: str | None) -> DataFrame:
    """All columns of df plus __reason: null for a row whose score and payload are valid or missing."""
    packed = df.withColumn("__score", F.col(score_col).cast("string") if score_col else F.lit(None).cast("string"))
    packed = packed.withColumn("__payload", F.col(payload_col).cast("string") if payload_col else F.lit(None).cast("string"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["__reason string"])
    return packed.mapInArrow(_values_batches(score_col is not None, payload_col is not None), schema)


def header_delimiter(header: str) -> str:
    """The delimiter of a header line: the candidate that occurs most, a comma if none does."""
    counts = {d: header.count(d) for d in (",", ";", "\t", "|")}
    best = max(counts, key=lambda d: counts[d])
    return best if counts[best] else ","


def _parse_block(lines: list[str], delimiter: str, width: int) -> pa.Table | None:
    """The block as a table of text columns, or None if any record of it may be bad."""
    names = [f"f{i}" for i in range(width)]
    try:
        data = "\n".join([*lines, ""]).encode()
        table = pacsv.read_csv(
            pa.BufferReader(data),
            # One block: a record that holds line breaks may not be cut.
            pacsv.ReadOptions(column_names=names, use_threads=False, block_size=len(data) + 1),
            pacsv.ParseOptions(delimiter=delimiter, newlines_in_values=True, ignore_empty_lines=False),
            pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False),
        )
    except (pa.ArrowInvalid, UnicodeError):
        return None
    return table if table.num_rows == len(lines) and table.num_columns == width else None


def _strict_quotes(lines: pa.Array, delimiter: str) -> bool:
    d = re.escape(delimiter) if delimiter != "\t" else r"\t"
    field = rf'(?:"(?:[^"]|"")*"|[^"{d}]*)'
    return bool(pc.all(pc.match_substring_regex(lines, rf"(?s)^{field}(?:{d}{field})*$")).as_py())


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (line_id, file_name, line_no, dataset, raw_line, header): adds __reason, the loaded __fields and the header's __names."""
    for batch in batches:
        lines, headers = batch.column("raw_line").to_pylist(), batch.column("header").to_pylist()
        datasets = batch.column("dataset").to_pylist()
        reasons: list[str | None] = [None] * len(batch)
        loaded: list[list[str] | None] = [None] * len(batch)
        names: list[list[str] | None] = [None] * len(batch)
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(headers, datasets)):
            groups.setdefault(key, []).append(i)
        for (header, dataset), rows in groups.items():
            delimiter = header_delimiter(header or "")
            columns = split_record(header, delimiter)[0] if header else None
            width = len(columns) if columns else None
            trimmed = [c.strip() for c in columns] if columns else None
            for i in rows:
                names[i] = trimmed
            at = {c.strip(): k for k, c in enumerate(columns or [])}
            score = at.get("score_text") if dataset == "scores" else None
            payload = at.get("payload_text" if dataset == "scores" else "payload_json")

            def bulk(lo: int, hi: int) -> bool:
                own = [lines[i] for i in rows[lo:hi]]
                if width is None or not _strict_quotes(pa.array(own, pa.string()), delimiter):
                    return False
                table = _parse_block(own, delimiter, width)
                if table is None:
                    return False
                if score is not None and not _all_numbers(table.column(score).combine_chunks()):
                    return False
                if payload is not None and not _all_objects(table.column(payload).combine_chunks()):
                    return False
                cells = [c.to_pylist() for c in table.columns]
                for k, i in enumerate(rows[lo:hi]):
                    loaded[i] = [c[k] for c in cells]
                return True

            def single(k: int) -> None:
                i = rows[k]
                fields, reason = split_record(lines[i], delimiter)
                if reason is None and width is not None and len(fields) != width:
                    reason = "column_count"
                if reason is None and width is not None:
                    take = lambda c: fields[c] if c is not None else None
                    reason = _value_reason(take(score), take(payload))
                reasons[i] = reason
                loaded[i] = fields if reason is None else None

            bisect(len(rows), bulk, single)
        yield batch.append_column("__reason", pa.array(reasons, pa.string())).append_column("__fields", pa.array(loaded, pa.list_(pa.string()))).append_column("__names", pa.array(names, pa.list_(pa.string())))


#: Most files whose headers are broadcast, and the salts of the join beyond.
BROADCAST_FILES, SALTS = 100_000, 32


def judge_lines(lines: DataFrame) -> DataFrame:
    """Records of delimited files, each with __reason (null if valid) and its __fields (null if bad).

    Needs line_id, file_name, line_no, dataset, raw_line. line_no 1 is the header; null and empty lines are
    dropped. A file without a header is judged for its quotes alone, split at commas. Headers, one per file, are
    broadcast if they are few; otherwise they are joined on the file and a salt, so that no file is one task's.
    """
    headers = (
        lines.where((F.col("line_no") == 1) & F.col("raw_line").isNotNull())
        .groupBy("file_name")
        .agg(F.min("raw_line").alias("header"))
    )
    headers = cut(headers)
    body = lines.where(((F.col("line_no") != 1) | F.col("line_no").isNull()) & F.col("raw_line").isNotNull() & (F.col("raw_line") != ""))
    body = body.select("line_id", "file_name", "line_no", "dataset", "raw_line")
    if headers.count() <= BROADCAST_FILES:
        body = body.join(F.broadcast(headers), "file_name", "left")
    else:
        headers = headers.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        body = body.withColumn("__salt", F.pmod(F.xxhash64("line_id", "raw_line"), F.lit(SALTS)).cast("int")).join(headers, ["file_name", "__salt"], "left")
    body = body.select("line_id", "file_name", "line_no", "dataset", "raw_line", "header")
    schema = "line_id bigint, file_name string, line_no int, dataset string, raw_line string, header string, __reason string, __fields array<string>, __names array<string>"
    return body.mapInArrow(_line_batches, schema)


def bad_rows(raw_lines: DataFrame, scores: DataFrame, metadata_cases: DataFrame) -> DataFrame:
    """(source_table, row_key, reason) of every bad row, each once."""
    judged = [
        ("raw_lines", judge_lines(raw_lines), "line_id"),
        ("scores", judge_values(scores.select("row_id", "score_text", "payload_text"), "score_text", "payload_text"), "row_id"),
        ("metadata_cases", judge_values(metadata_cases.select("case_id", "payload_json"), None, "payload_json"), "case_id"),
    ]
    out = None
    for name, df, key in judged:
        bad = df.where(F.col("__reason").isNotNull()).select(
            F.lit(name).alias("source_table"), F.col(key).cast("string").alias("row_key"), F.col("__reason").alias("reason")
        )
        out = bad if out is None else out.unionAll(bad)
    return out.distinct()


def load_lines(raw_lines: DataFrame) -> DataFrame:
    """The valid records as a table: line_id, file_name, dataset and a map from the header's columns to the fields."""
    good = judge_lines(raw_lines).where(F.col("__reason").isNull())
    same = F.size("__names") == F.size("__fields")
    return good.select("line_id", "file_name", "line_no", "dataset", F.when(same, F.map_from_arrays("__names", "__fields")).alias("fields"))


def load_values(df: DataFrame, key: str, score_col: str | None, payload_col: str | None) -> DataFrame:
    """The valid rows of a table, redelivered ones once (as they first arrived): row_key, and all columns as JSON in fields."""
    columns = [c for c in df.columns if c != "arrived_at"]
    once = df.groupBy(*columns).agg(F.min("arrived_at").alias("arrived_at")) if "arrived_at" in df.columns else df.distinct()
    good = judge_values(once, score_col, payload_col).where(F.col("__reason").isNull())
    # Without a format of their own, times lose their microseconds.
    exact = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    fields = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false", "timestampNTZFormat": exact, "timestampFormat": exact + "XXX"})
    return good.select(F.col(key).cast("string").alias("row_key"), fields.alias("fields"))


def load_all(raw_lines: DataFrame, scores: DataFrame, metadata_cases: DataFrame) -> DataFrame:
    """The valid rows of all three tables: source_table, row_key, fields (JSON), and where a record came from a file, its place."""
    lines = load_lines(raw_lines).select(
        F.lit("raw_lines").alias("source_table"), F.col("line_id").cast("string").alias("row_key"), "file_name", "line_no", "dataset", F.to_json("fields").alias("fields")
    )
    loaded = lines
    for name, df in (
        ("scores", load_values(scores, "row_id", "score_text", "payload_text")),
        ("metadata_cases", load_values(metadata_cases, "case_id", None, "payload_json")),
    ):
        loaded = loaded.unionByName(df.withColumn("source_table", F.lit(name)), allowMissingColumns=True)
    return loaded
