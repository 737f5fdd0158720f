"""Full-text search over an inverted index: AND by default, OR, NOT, phrases in quotes, prefixes with a star, columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreweave.functions.stemming import TOKEN, terms, terms_of

_PART = re.compile(r'\s*(\(|\)|"[^"]*"\*?|[^\s()"]+)')


def ascii_words(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, unstemmed. `İ` is an i, as SQL engines fold it."""
    return F.filter(F.split(F.lower(F.translate(text, "\u0130", "i")), "[^a-z0-9]+"), lambda w: w != "")


def index(docs: DataFrame, key: str, columns: list[str], words: Callable[[Column], Column] = terms_of) -> DataFrame:
    """term, id, column, pos of every word: written once, partitioned or bucketed by term, it serves all searches.

    words: the array of a text's terms, stemmed words by default. Searches look stems up, so an index of plain words finds
    those that are their own stems.
    """
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("")).alias("text")) for c in columns))).alias("p")
    rows = docs.select(F.col(key).alias("id"), parts).select("id", "p.column", words(F.col("p.text")).alias("terms"))
    return rows.select("id", "column", F.posexplode("terms").alias("pos", "term"))


def parse(query: str) -> tuple:
    """A tree of ("and" | "or" | "not", a, b) and ("words", column, [(term, prefix)]); ValueError if it isn't one."""
    parts, at = [], 0
    text = query.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"unbalanced quote in {query!r}")
        parts.append(m[1])
        at = m.end()
    place = 0

    def peek() -> str | None:
        return parts[place] if place < len(parts) else None

    def take() -> str:
        nonlocal place
        if place >= len(parts):
            raise ValueError(f"{query!r} ends early")
        place += 1
        return parts[place - 1]

    def either() -> tuple:
        left = both()
        while peek() == "OR":
            take()
            left = ("or", left, both())
        return left

    def both() -> tuple:
        left = one()
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                take()
                left = ("and", left, one())
            elif peek() == "NOT":
                take()
                left = ("not", left, one())
            else:
                left = ("and", left, one())
        return left

    def one() -> tuple:
        part = take()
        if part == "(":
            inner = either()
            if take() != ")":
                raise ValueError(f"unbalanced bracket in {query!r}")
            return inner
        if part in (")", "AND", "OR", "NOT"):
            raise ValueError(f"{part} is out of place in {query!r}")
        column = None
        if ":" in part and not part.startswith('"'):
            column, _, part = part.partition(":")
            part = part or take()
        prefix = part.endswith("*")
        found = TOKEN.findall(part.rstrip("*").strip('"').lower())
        if not found:
            raise ValueError(f"{part!r} has no word")
        stems = terms(" ".join(found))
        if prefix:
            stems[-1] = found[-1]
        return ("words", column, [(s, prefix and i == len(stems) - 1) for i, s in enumerate(stems)])

    if not parts:
        raise ValueError("an empty search")
    tree = either()
    if peek() is not None:
        raise ValueError(f"{peek()} is out of place in {query!r}")
    return tree


def match(inverted: DataFrame, query: str) -> DataFrame:
    """id of the documents that match: term lookups joined by id, in the index only."""
    def words(column: str | None, wanted: list[tuple[str, bool]]) -> DataFrame:
        rows = inverted.where(F.col("column") == column) if column else inverted
        out = None
        for i, (term, prefix) in enumerate(wanted):
            hit = rows.where(F.col("term").startswith(term) if prefix else F.col("term") == term).select("id", "column", (F.col("pos") - i).alias("start"))
            out = hit if out is None else out.join(hit, ["id", "column", "start"], "left_semi")
        return out.select("id").distinct()

    def run(tree: tuple) -> DataFrame:
        if tree[0] == "words":
            return words(*tree[1:])
        left, right = run(tree[1]), run(tree[2])
        return left.unionByName(right).distinct() if tree[0] == "or" else left.join(right, "id", "left_semi" if tree[0] == "and" else "left_anti")

    return run(parse(query))


def refreshed(inverted: DataFrame, changed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The index with the rows of the changed documents taken out and made anew; documents without words only go."""
    stale = changed.select(F.col(key).alias("id")).distinct()
    return inverted.join(stale, "id", "left_anti").unionByName(index(changed, key, columns).select(inverted.columns))
