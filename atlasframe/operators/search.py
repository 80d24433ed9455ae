"""Searching names: an inverted index with exact and prefix terms, phrases and nearness, and prefixes of
whole names.

The gazetteer's users are meant to complete names as they type; these operators serve that intent.  An
index is a table of postings: terms with their row and, for phrases, their column and place in it.  Written
with ``save_postings`` it is in the order of terms, so that a term's blocks are found by the least and
greatest terms that Parquet keeps, and a term in many rows is spread over several files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_terms, term_places

#: The columns of a full-text table that are searched.
FIELDS = ("longname", "asciiname", "admin1", "country", "timezone")


def postings(df: DataFrame, row_id: str, *columns: str) -> DataFrame:
    """term and row id, once for each term of a row; write it sorted by term to search large tables."""
    text = F.concat_ws(" ", *columns)
    return df.select(F.explode(search_terms(text)).alias("term"), F.col(row_id))


def match(index: DataFrame, query: str, row_id: str) -> DataFrame:
    """Ids of rows that have every term of ``query``; a term that ends in ``*`` is a prefix."""
    terms = sorted({t.lower() for t in query.split()})
    hits = None
    for k, term in enumerate(terms):
        test = F.startswith("term", F.lit(term[:-1])) if term.endswith("*") else F.col("term") == term
        part = index.where(test).select(row_id, F.lit(k).alias("_k"))
        hits = part if hits is None else hits.unionAll(part)
    if hits is None:
        return index.where(F.lit(False)).select(row_id)
    return hits.distinct().groupBy(row_id).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(terms)).select(row_id)


def positional_postings(df: DataFrame, row_id: str, *columns: str) -> DataFrame:
    """term, row id, field (a column's number) and place (a term's number in it), once for each occurrence."""
    each = F.array(*[F.struct(F.lit(k).alias("field"), term_places(F.col(c)).alias("terms")) for k, c in enumerate(columns)])
    fields = df.select(F.col(row_id), F.inline(each))
    return fields.select(F.posexplode("terms").alias("place", "term"), F.col(row_id), "field").select("term", row_id, "field", "place")


def save_postings(index: DataFrame, path: str, files: int | None = None) -> None:
    """Write an index in the order of its terms, and of rows within a term."""
    order = [F.col(c) for c in index.columns]
    spread = index.repartitionByRange(files, *order) if files else index.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def _test(term: str) -> Column:
    return F.startswith("term", F.lit(term[:-1])) if term.endswith("*") else F.col("term") == term


def _begins(index: DataFrame, words: str, row_id: str) -> DataFrame:
    """row id, field, place and end of each occurrence of a phrase; its last word may end in ``*``.

    A posting votes for the place where the phrase would begin; no postings are joined with each other."""
    plain = re.sub("[A-Z]", lambda m: m[0].lower(), words)
    terms = re.findall(r"[a-z0-9\u0080-\U0010ffff]+\*?", plain)
    votes = None
    for k, term in enumerate(terms):
        part = index.where(_test(term)).select(row_id, "field", (F.col("place") - k).alias("place"), F.lit(k).alias("_k"))
        votes = part if votes is None else votes.unionAll(part)
    if votes is None:
        return index.where(F.lit(False)).select(row_id, "field", "place", F.col("place").alias("end"))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_k")))
    met = votes.groupBy(row_id, "field", "place").agg(bits.alias("_bits")).where(F.col("_bits") == (1 << len(terms)) - 1)
    return met.select(row_id, "field", "place", (F.col("place") + len(terms) - 1).alias("end"))


def phrase(index: DataFrame, words: str, row_id: str) -> DataFrame:
    """Ids of rows that have the words (62 at most) next to each other, in this order, in one field."""
    return _begins(index, words, row_id).select(row_id).distinct()


def near(index: DataFrame, first: str, second: str, within: int, row_id: str) -> DataFrame:
    """Ids of rows where two phrases, in either order, have no more than ``within`` terms between them and
    don't overlap.  Occurrences meet by stretches of their field, so far ones never do."""
    most = within + 1 + max(len(first.split()), len(second.split()))
    a, b = (_begins(index, words, row_id) for words in (first, second))
    here = a.select(row_id, "field", F.col("place").alias("_a"), F.col("end").alias("_z"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("place") / most) + k)).alias("_cell"))
    there = b.withColumn("_cell", F.floor(F.col("place") / most))
    gap = F.greatest(F.col("place") - F.col("_z"), F.col("_a") - F.col("end")) - 1
    return here.join(there, [row_id, "field", "_cell"]).where((gap >= 0) & (gap <= within)).select(row_id).distinct()


#: A part of a query: perhaps a field's name, then a phrase or a word.
_PART = re.compile(r'(?:([A-Za-z_]\w*):)?(?:"([^"]*)"|([^\s"]+))')


def match_text(index: DataFrame, query: str, row_id: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """Ids of rows that match a full-text query over positional postings.

    Words and quoted phrases must all occur; ``*`` ends a prefix, ``name:`` asks one of ``fields`` only,
    ``NEAR`` or ``NEAR/n`` stands between two that have 10, or n, terms between them at most, ``NOT`` before one
    that must not occur.  ``OR`` parts whole alternatives.  What asks for nothing finds nothing.
    """

    def of(field: str | None) -> DataFrame:
        return index.where(F.col("field") == fields.index(field)) if field else index

    alternatives: list[tuple[list[DataFrame], list[DataFrame]]] = [([], [])]
    link, before = "", None
    for field, quoted, word in _PART.findall(query):
        if word == "OR" and not field:
            alternatives.append(([], []))
        if word in ("OR", "AND", "NOT") or re.fullmatch(r"NEAR(/\d+)?", word):
            link = word
            continue
        text, field = (quoted or word, field) if field in fields else (f"{field} {quoted or word}", None)
        if not re.search(r"[A-Za-z0-9\u0080-\U0010ffff]", text):
            continue
        wanted, unwanted = alternatives[-1]
        if link == "NOT":
            unwanted.append(phrase(of(field), text, row_id))
        elif link.startswith("NEAR") and before and before[1] == field:
            wanted.append(near(of(field), before[0], text, int(link.partition("/")[2] or 10), row_id))
        else:
            wanted.append(phrase(of(field), text, row_id))
        link, before = "", (text, field)
    out = None
    for wanted, unwanted in alternatives:
        if not wanted:
            continue
        hits = wanted[0]
        for other in wanted[1:]:
            hits = hits.join(other, row_id, "left_semi")
        for other in unwanted:
            hits = hits.join(other, row_id, "left_anti")
        out = hits if out is None else out.unionAll(hits)
    return index.where(F.lit(False)).select(row_id) if out is None else out.distinct()


def name_prefix(df: DataFrame, column: str, prefix: str, limit: int = 50) -> DataFrame:
    """Rows whose name begins with ``prefix``, in name order."""
    return df.where(F.startswith(column, F.lit(prefix))).orderBy(*([column] + [c for c in df.columns if c != column])).limit(max(0, limit))
