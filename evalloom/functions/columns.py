"""Catalog functions that Spark expresses itself, as column expressions; they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .native import ENTRY_FIELDS, INITIAL_RATING, K_FACTOR


def _or(c: Column | None, default: float) -> Column:
    return F.lit(default) if c is None else F.coalesce(c.cast("double"), F.lit(default))


def elo_expected_score(rating_a: Column, rating_b: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (_or(rating_b, INITIAL_RATING) - _or(rating_a, INITIAL_RATING)) / 400.0))


def elo_rating_delta(rating_a: Column, rating_b: Column, outcome_a: Column | None = None, k_factor: Column | None = None) -> Column:
    return _or(k_factor, K_FACTOR) * (_or(outcome_a, 0.5) - elo_expected_score(rating_a, rating_b))


def elo_final_rating(target: Column, models_a: Column, models_b: Column, outcomes_a: Column, k_factor: Column | None = None, initial: Column | None = None) -> Column:
    """Games replayed in order by a fold over the zipped sequences, with the ratings in a map."""
    start = _or(initial, INITIAL_RATING)
    shortest = F.least(F.size(models_a), F.size(models_b), F.size(outcomes_a))
    a_of, b_of, o_of = (lambda g: g["a"]), (lambda g: g["b"]), (lambda g: g["o"])

    def play(ratings: Column, game: Column) -> Column:
        a, b = a_of(game), b_of(game)
        ra, rb = F.coalesce(F.try_element_at(ratings, a), start), F.coalesce(F.try_element_at(ratings, b), start)
        change = elo_rating_delta(ra, rb, o_of(game), k_factor)
        others = F.map_filter(ratings, lambda k, v: (k != a) & (k != b))
        changed = F.when(a == b, F.create_map(b, rb - change)).otherwise(F.map_from_arrays(F.array(a, b), F.array(ra + change, rb - change)))
        known = a.isNotNull() & b.isNotNull() & (a != "") & (b != "")
        return F.when(known, F.map_concat(others, changed)).otherwise(ratings)

    games = _zipped(models_a, models_b, outcomes_a, shortest)
    ratings = F.aggregate(games, F.expr("CAST(map() AS map<string,double>)"), play)
    return F.when(target.isNull() | (target == ""), F.lit(INITIAL_RATING)).otherwise(F.coalesce(F.try_element_at(ratings, target), start))


def _zipped(a: Column, b: Column, o: Column, n: Column) -> Column:
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.get(a, i).cast("string").alias("a"), F.get(b, i).cast("string").alias("b"), F.get(o, i).cast("double").alias("o")))


def entry(**fields: Column) -> Column:
    """A DirectoryEntry of all its fields; those not given are null."""
    kinds = {"is_empty_dir": "boolean", "size_bytes": "bigint"}
    return F.struct(*[fields.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in ENTRY_FIELDS])


def entry_path(e: Column) -> Column:
    return F.coalesce(e["path"], e["dataset_path"], F.lit(""))


def entries_exist(entries: Column, path: Column) -> Column:
    return F.coalesce(F.exists(entries, lambda e: entry_path(e) == path), F.lit(False))


def entries_find(entries: Column, path: Column) -> Column:
    return F.get(F.filter(entries, lambda e: entry_path(e) == path), F.lit(0))


def glob_pattern(pattern: str) -> str:
    """A shell pattern as a regular expression for rlike."""
    out = {"*": ".*", "?": "."}
    return "^" + "".join(out.get(ch, "\\" + ch if not ch.isalnum() and ch not in "_/" else ch) for ch in pattern) + "$"


def entries_glob(entries: Column, pattern: str) -> Column:
    return F.filter(entries, lambda e: entry_path(e).rlike(glob_pattern(pattern)))


def filter_paths(path: Column, include: list[str] | None, exclude: list[str] | None) -> Column:
    """Regular-expression filters of a directory listing; both compile to pushed-down row predicates."""
    keep = F.lit(True)
    if include:
        keep = keep & path.rlike("|".join(f"(?:{p})" for p in include))
    if exclude:
        keep = keep & ~path.rlike("|".join(f"(?:{p})" for p in exclude))
    return keep
