"""Deterministic functions of the catalog: scoring, ranking, parsing, archives, object listings, specs.

Pure Python over plain values, so that they serve row functions, Arrow batches and tests alike; those that Spark
can express are in columns.py as column expressions.
"""

from __future__ import annotations

import base64
import csv
import fnmatch
import hashlib
import io
import json
import mimetypes
import os
import re
import tarfile
import zipfile
from collections.abc import Mapping
from typing import Any

from .agents import ORDERINGS, as_json, schema_match, step_adherence  # noqa: F401

# --- ranking ------------------------------------------------------------------------------------------------------

INITIAL_RATING, K_FACTOR = 1500.0, 32.0


def number(value: Any, default: float) -> float:
    try:
        return default if value is None or isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return default


def expected_score(rating_a: Any, rating_b: Any) -> float:
    """Chance that a beats b; a missing rating is the initial one."""
    gap = number(rating_b, INITIAL_RATING) - number(rating_a, INITIAL_RATING)
    return 1.0 / (1.0 + 10.0 ** (gap / 400.0))


def rating_delta(rating_a: Any, rating_b: Any, outcome_a: Any = None, k_factor: Any = None) -> float:
    return number(k_factor, K_FACTOR) * (number(outcome_a, 0.5) - expected_score(rating_a, rating_b))


def final_rating(target_model: Any, model_a_seq: Any, model_b_seq: Any, outcome_a_seq: Any, k_factor: Any = None, initial_rating: Any = None) -> float:
    """A model's rating after a sequence of games, played in order; games without both names are passed over."""
    if target_model is None or str(target_model) == "":
        return INITIAL_RATING
    start, ratings = number(initial_rating, INITIAL_RATING), {}
    for a, b, outcome in zip(model_a_seq or [], model_b_seq or [], outcome_a_seq or []):
        if a in (None, "") or b in (None, ""):
            continue
        before = [ratings.get(str(m), start) for m in (a, b)]
        change = rating_delta(*before, outcome, k_factor)
        ratings[str(a)] = before[0] + change
        ratings[str(b)] = before[1] - change
    return ratings.get(str(target_model), start)


# --- text ---------------------------------------------------------------------------------------------------------


def fenced_blocks(content: str | None, fence_type: str | None = None) -> list:
    """Closed code blocks of a text: their contents if a kind is asked for, else [kind, content] pairs."""
    if not content:
        return []
    if not re.search(r"[\r\n]", content):
        content = re.sub(r"\\r\\n|\\n|\\r", "\n", content)
    out, opened, body = [], None, []
    for line in content.splitlines():
        mark = line.lstrip()
        if not mark.startswith("```"):
            body.append(line)
        elif opened is None:
            opened, body = (mark[3:].split() or [""])[0], []
        else:
            text = "\n".join(body).strip()
            if fence_type is None:
                out.append([opened, text])
            elif fence_type.strip().lower() in ("", opened.lower()):
                out.append(text)
            opened, body = None, []
    return out


# --- data ---------------------------------------------------------------------------------------------------------

MAX_ROWS, MAX_CHARS = 500, 2_000_000


def whole(value: Any, default: int) -> int:
    try:
        return max(0, int(value)) if value is not None else default
    except (TypeError, ValueError):
        return default


def parse_json(content: str | None) -> str | None:
    """The JSON text written anew; null for none."""
    return json.dumps(json.loads(content), ensure_ascii=False) if content else None


def _table(columns: list[str], rows: list[dict], truncated: bool) -> str:
    return json.dumps({"columns": columns, "rows": rows, "row_count": len(rows), "truncated": truncated}, ensure_ascii=False)


def parse_csv(content: str | None, delimiter: str | None = None, quotechar: str | None = None, has_header: bool | None = None, max_rows: int | None = None) -> str | None:
    if content is None:
        return None
    reader = csv.reader(io.StringIO(content), delimiter=(delimiter or ",")[:1], quotechar=(quotechar or '"')[:1])
    lines = (r for r in reader if r)
    columns = [str(c) for c in next(lines, [])] if has_header in (None, True) else None
    rows, most = [], whole(max_rows, MAX_ROWS)
    for line in lines:
        if len(rows) >= most:
            return _table(columns or [], rows, True)
        columns = columns if columns is not None else [f"c{i + 1}" for i in range(len(line))]
        rows.append({c: line[i] if i < len(line) else "" for i, c in enumerate(columns)})
    return _table(columns or [], rows, False)


def parse_parquet(content_base64: str | None, columns_csv: str | None = None, max_rows: int | None = None) -> str | None:
    if not content_base64:
        return None
    import pyarrow.parquet as pq

    wanted = [c.strip() for c in columns_csv.split(",") if c.strip()] if columns_csv else None
    table = pq.read_table(io.BytesIO(base64.b64decode(content_base64)), columns=wanted)
    most = whole(max_rows, MAX_ROWS)
    rows = json.loads(json.dumps(table.slice(0, most).to_pylist(), default=str))
    return _table(table.column_names, rows, table.num_rows > most)


def parse_pdf(content_base64: str | None, max_pages: int | None = None, max_chars: int | None = None) -> str | None:
    """Text of a PDF; a JSON error where no PDF reader is installed."""
    if not content_base64:
        return None
    try:
        from pypdf import PdfReader
    except ImportError:
        return json.dumps({"error": "UNAVAILABLE", "message": "no PDF reader is installed"})
    reader = PdfReader(io.BytesIO(base64.b64decode(content_base64)))
    texts = [p.extract_text() or "" for p in reader.pages[: whole(max_pages, 50)]]
    return json.dumps({"page_count": len(reader.pages), "text": "\n\n".join(texts)[: whole(max_chars, 200_000)]}, ensure_ascii=False)


def bundle(texts, most: int) -> str:
    """Documents one after another, numbered, cut where the bundle is full."""
    parts, left = [], most
    for i, text in enumerate(texts, 1):
        part = f"BEGIN DOCUMENT {i}:\n{text}\nEND DOCUMENT {i}"[:left]
        parts.append(part)
        left -= len(part)
        if left <= 0:
            break
    return "\n\n".join(parts)


def _members(member_paths_json: str) -> list[str]:
    value = json.loads(member_paths_json)
    return [str(v) for v in (value if isinstance(value, list) else [value])]


def unzip(content_base64: str | None, member_paths_json: str | None, max_chars: int | None = None) -> str | None:
    if not content_base64 or not member_paths_json:
        return None
    with zipfile.ZipFile(io.BytesIO(base64.b64decode(content_base64))) as archive:
        return bundle((archive.read(m).decode("utf-8", "replace") for m in _members(member_paths_json)), whole(max_chars, MAX_CHARS))


def untar(content_base64: str | None, member_paths_json: str | None, max_chars: int | None = None) -> str | None:
    if not content_base64 or not member_paths_json:
        return None
    with tarfile.open(fileobj=io.BytesIO(base64.b64decode(content_base64)), mode="r:*") as archive:
        files = (archive.extractfile(m) for m in _members(member_paths_json))
        return bundle((f.read().decode("utf-8", "replace") for f in files if f is not None), whole(max_chars, MAX_CHARS))


# --- object listings ----------------------------------------------------------------------------------------------

ENTRY_FIELDS = ("content_type", "dataset_path", "entry_type", "is_empty_dir", "name", "object_uri", "parent_path", "path", "schema_version", "sha256", "size_bytes")


def _entry_path(entry: Mapping) -> str:
    return str(entry.get("path") or entry.get("dataset_path") or "")


def find_entry(entries: list | None, path: str | None) -> dict | None:
    return next((dict(e) for e in entries or [] if e is not None and path is not None and _entry_path(e) == path.strip("/")), None)


def exists(entries: list | None, path: str | None) -> bool:
    return find_entry(entries, path) is not None


def glob_entries(entries: list | None, pattern: str | None) -> list:
    return [dict(e) for e in entries or [] if e is not None and pattern is not None and fnmatch.fnmatchcase(_entry_path(e), pattern)]


#: Most bytes of an object that is read into a cell; a larger one is an error, never a prefix.
MAX_READ_BYTES = 2_000_000


def _local(uri: str) -> str:
    if "://" in uri and not uri.startswith("file://"):
        raise ValueError(f"{uri} is no local file")
    return uri.removeprefix("file://")


def read_text(entries: list | None, path: str | None) -> str:
    """Content of a file entry whose object is a local file; an error if it isn't there, too large or no UTF-8."""
    entry = find_entry(entries, path)
    if entry is None or not entry.get("object_uri"):
        raise FileNotFoundError(path)
    if entry.get("entry_type") not in (None, "file"):
        raise IsADirectoryError(path)
    uri = _local(str(entry["object_uri"]))
    if max(int(entry.get("size_bytes") or 0), os.path.getsize(uri)) > MAX_READ_BYTES:
        raise ValueError(f"{path} has more than {MAX_READ_BYTES} bytes")
    with open(uri, "rb") as f:
        return f.read().decode("utf-8")


def read_json(entries: list | None, path: str | None) -> str:
    """The same as compact JSON with sorted keys."""
    return json.dumps(json.loads(read_text(entries, path)), separators=(",", ":"), sort_keys=True)


def _put(root: str, path: str, payload: bytes, content_type: str | None) -> list[dict]:
    """Store an object below the run's shared folder under its content's hash; a repeated call stores the same."""
    name = path.strip("/")
    if not name or any(p in ("", ".", "..") for p in name.split("/")):
        raise ValueError(f"{path} is no path of an object")
    digest = hashlib.sha256(payload).hexdigest()
    place = f"{_local(root)}/{digest[:2]}/{digest}"
    if not os.path.exists(place):
        os.makedirs(os.path.dirname(place), exist_ok=True)
        part = f"{place}.{os.getpid()}"
        with open(part, "wb") as f:
            f.write(payload)
        os.replace(part, place)
    parent, _, last = name.rpartition("/")
    known = {"dataset_path": name, "path": name, "name": last, "parent_path": parent, "entry_type": "file", "size_bytes": len(payload), "sha256": digest, "object_uri": f"file://{place}"}
    known |= {"content_type": content_type or mimetypes.guess_type(last)[0] or "application/octet-stream", "is_empty_dir": False, "schema_version": "1"}
    return [{n: known[n] for n in ENTRY_FIELDS}]


def write_text(path: str, content: str, content_type: str | None = None, root: str = "") -> list[dict]:
    return _put(root, path, str(content).encode("utf-8"), content_type or mimetypes.guess_type(path)[0] or "text/plain")


def write_json(path: str, value: Any, root: str = "") -> list[dict]:
    """Compact JSON with sorted keys; text counts as the JSON it holds."""
    held = json.loads(value) if isinstance(value, str) else value
    return _put(root, path, json.dumps(held, separators=(",", ":"), sort_keys=True).encode(), "application/json")


# --- simulations --------------------------------------------------------------------------------------------------


def simulate(agent, user, observers: list | None = None, max_turns: int = 10, first: Any = None) -> dict:
    """The turn loop of a simulation over two callbacks; a failing callback ends it with its error."""
    turns, seen, message, error, status = [], [], first, None, "completed"
    for turn in range(max_turns):
        try:
            request = user(turn, message)
            if request is None:
                break
            message = agent(turn, request)
        except Exception as e:  # noqa: BLE001
            error, status = {"code": "RUNTIME_PYTHON_ERROR", "message": str(e), "retryable": False}, "failed"
            break
        turns.append({"turn": turn, "request": request, "response": message, "terminate": False})
        seen += [{"turn": turn, "observation": o(turn, message)} for o in observers or []]
    return {"ok": error is None, "status": status, "final_output": message, "turns": turns, "observations": seen, "artifacts": [], "error": error}


# --- tool calls of agents -----------------------------------------------------------------------------------------


def _calls(value: Any) -> list[tuple[str, str]]:
    """(name, canonical arguments) of the tool calls in a conversation or a list of calls."""
    value, out = as_json(value), []
    for item in value if isinstance(value, list) else [value] if value else []:
        for call in item.get("tool_calls") or ([item] if "name" in item else []) if isinstance(item, dict) else []:
            out.append((str(call.get("name")), json.dumps(as_json(call.get("args", call.get("arguments"))) or {}, sort_keys=True)))
    return out


def tool_call_f1(user_input: Any, reference_tool_calls: Any) -> dict:
    """Balance of precision and recall of the calls made, each with its arguments."""
    made, wanted = set(_calls(user_input)), set(_calls(reference_tool_calls))
    hits = len(made & wanted)
    precision, recall = hits / len(made) if made else 0.0, hits / len(wanted) if wanted else 0.0
    value = 2 * precision * recall / (precision + recall) if hits else 0.0
    return {"value": round(value, 4), "reason": f"{hits} of {len(made)} calls are among the {len(wanted)} wanted"}


def tool_call_accuracy(user_input: Any, reference_tool_calls: Any, strict_order: bool = True) -> dict:
    """Share of the wanted calls that were made with equal arguments; 0 if the order differs and must not."""
    made, wanted = _calls(user_input), _calls(reference_tool_calls)
    if not wanted:
        return {"value": 0.0, "reason": "no reference calls"}
    names = [n for n, _ in made]
    ordered = names == [n for n, _ in wanted] if strict_order else sorted(names) == sorted(n for n, _ in wanted)
    hits = sum(a == b for a, b in zip(made, wanted)) if strict_order else sum(w in made for w in wanted)
    return {"value": hits / len(wanted) if ordered else 0.0, "reason": f"{hits} of {len(wanted)} calls agree" + ("" if ordered else ", in another order")}


def datacompy_score(reference: str | None, response: str | None, mode: str = "rows", metric: str = "f1") -> dict:
    """Rows (or columns) that two CSV tables share, as precision, recall or their balance."""
    tables = [list(csv.reader(io.StringIO(t or ""))) for t in (reference, response)]
    parts = [{tuple(r) for r in t[1:]} if mode == "rows" else {tuple(c) for c in zip(*t)} for t in tables]
    hits = len(parts[0] & parts[1])
    precision, recall = hits / len(parts[1]) if parts[1] else 0.0, hits / len(parts[0]) if parts[0] else 0.0
    f1 = 2 * precision * recall / (precision + recall) if hits else 0.0
    return {"value": {"precision": precision, "recall": recall}.get(metric, f1), "reason": f"{hits} {mode} are the same"}


# --- test functions -----------------------------------------------------------------------------------------------


def normalize_text(text: str | None) -> str | None:
    return None if text is None else " ".join(text.lower().split())


def extract_json_score(text: str | None) -> float | None:
    """The number under `score` of a JSON object; an error for anything else."""
    return None if text is None else float(json.loads(text)["score"])


def controlled_echo(text: str | None) -> str | None:
    return text
