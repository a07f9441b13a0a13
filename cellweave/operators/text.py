"""Full-text search: tokens, inverted index, BM25, phrases, fuzzy terms, highlights.

The index is two tables (documents with lengths, postings with positions). A query
is parsed on the driver, its statistics (a count for each of its terms, 50 expansions
of a fuzzy term at most) are read first; each clause then becomes rows (document,
score) and a document's score is their sum, so ranking is one grouped sum and the
engine's top-k. Only what a query touches is read: terms are pushed down as
predicates. A collection in several indexes is ranked as one: ``Statistics.merged``
of all, then each index's search with them.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from math import log

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import auto_edits, damerau, found_clauses, phrase_count, sloppy_frequency, snippet, words
from ..plans.tables import cut_lineage

K1, B = 1.2, 0.75
MAX_TERM_BYTES, MAX_TERMS = 64, 10_000
EXPANSIONS = 50
#: Tokens that a Python worker hands on at once.
TOKENS = 1 << 14


class QueryError(ValueError):
    """A query string that can't be read, with the place of the fault."""


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Phrase:
    text: str
    slop: int = 0


@dataclass(frozen=True)
class Fuzzy:
    text: str
    #: None: by length.
    edits: int | None = None


@dataclass(frozen=True)
class Statistics:
    """What a search ranks with: documents, their lengths summed, documents of each term, and of each fuzzy word its edits and expansions (term, distance, documents)."""

    docs: int
    length: int
    terms: dict[str, int]
    near: dict[str, tuple[int, list[tuple[str, int, int]]]]
    #: Fuzzy words that have more expansions than are held.
    cut: frozenset[str] = frozenset()

    @staticmethod
    def merged(parts: list[Statistics]) -> Statistics:
        """Those of all parts together. A part that cut a word's expansions can miss some that one index would hold."""
        if not parts:
            raise ValueError("no statistics to merge")
        terms, near, cut = dict.fromkeys(parts[0].terms, 0), {w: (e, {}) for w, (e, _) in parts[0].near.items()}, set()
        for x in parts:
            if x.terms.keys() != terms.keys() or {w: e for w, (e, _) in x.near.items()} != {w: e for w, (e, _) in near.items()}:
                raise ValueError("statistics of another query")
            for t, n in x.terms.items():
                terms[t] += n
            for w, (_, found) in x.near.items():
                for t, d, n in found:
                    near[w][1][t] = d, n + near[w][1].get(t, (d, 0))[1]
            cut |= x.cut
        ranked = {w: (e, _nearest((t, *x) for t, x in by.items())) for w, (e, by) in near.items()}
        cut |= {w for w, (_, found) in ranked.items() if len(found) > EXPANSIONS}
        return Statistics(sum(x.docs for x in parts), sum(x.length for x in parts), terms, {w: (e, found[:EXPANSIONS]) for w, (e, found) in ranked.items()}, frozenset(cut))

    def idf(self, df: int) -> float:
        return log(1 + (self.docs - df + 0.5) / (df + 0.5))


def _nearest(found) -> list[tuple[str, int, int]]:
    """Nearest first, then the most common, then by term's bytes."""
    return sorted(found, key=lambda x: (x[1], -x[2], x[0].encode()))


def parse(query: str) -> list[Term | Phrase | Fuzzy]:
    """Distinct clauses: words, "phrases", "phrases"~slop, word~, word~1, word~2; a backslash takes the next character as it is."""
    out, i, n = [], 0, len(query)

    def digits(i: int) -> int:
        j = i
        while j < n and query[j] in "0123456789":
            j += 1
        return j

    while i < n:
        if query[i].isspace():
            i += 1
        elif query[i] == '"':
            start, text, i = i, [], i + 1
            while True:
                if i >= n or (query[i] == "\\" and i + 1 >= n):
                    raise QueryError(f"a quote isn't closed, at {start}")
                if query[i] == '"':
                    break
                if query[i] == "~":
                    raise QueryError(f"fuzzy in a phrase, at {i}")
                i += query[i] == "\\"
                text.append(query[i])
                i += 1
            i, slop = i + 1, 0
            if i < n and query[i] == "~":
                j = digits(i + 1)
                if j == i + 1 or int(query[i + 1 : j]) > 65535 or (j < n and not query[j].isspace() and query[j] != '"'):
                    raise QueryError(f"a slop is wrong, at {i}")
                slop, i = int(query[i + 1 : j]), j
            out.append(Phrase("".join(text), slop))
        else:
            text, fuzzy, edits = [], False, None
            while i < n and not query[i].isspace() and query[i] != '"':
                if query[i] == "\\":
                    text.append(query[i + 1 : i + 2])
                    i += 2
                elif query[i] == "~":
                    j = digits(i + 1)
                    if query[i + 1 : j] not in ("", "1", "2") or (j < n and not query[j].isspace() and query[j] != '"'):
                        raise QueryError(f"a distance is wrong, at {i}")
                    fuzzy, edits, i = True, int(query[i + 1 : j] or 0) or None, j
                    break
                else:
                    text.append(query[i])
                    i += 1
            out.append(Fuzzy("".join(text), edits) if fuzzy else Term("".join(text)))
    return list(dict.fromkeys(out))


def tokenize(df: DataFrame, id_col: str, text_col: str, stop_words: bool = False, form: str | None = "NFC", tokenizer=None) -> DataFrame:
    """``tokenizer``: a function from a text to (term, position, start, end) in place of the built-in one. id, term, position, start, end (bytes): terms of over 64 bytes are left out; a text of over ``MAX_TERMS`` distinct others is refused. Null text has none."""
    kind = df.schema[id_col].dataType.simpleString()
    own = tokenizer or (lambda text: words(text, stop_words, form))

    def run(batches):
        for batch in batches:
            field = batch.schema.field(0).type

            def made(at, columns):
                keys = batch.column(0).take(pa.array(at, pa.int32()))
                return pa.RecordBatch.from_arrays([keys.cast(field), pa.array(columns[0], pa.string()), *[pa.array(x, pa.int32()) for x in columns[1:]]], ["id", "term", "position", "start", "end"])

            # One text at a time, and rows of about TOKENS handed on: memory doesn't grow with the batch.
            at, columns = [], ([], [], [], [])
            for i in range(batch.num_rows):
                found = [x for x in own(batch.column(1)[i].as_py() or "") if len(x[0]) * 4 <= MAX_TERM_BYTES or len(x[0].encode()) <= MAX_TERM_BYTES]
                distinct = len({x[0] for x in found}) if len(found) > MAX_TERMS else 0
                if distinct > MAX_TERMS:
                    raise ValueError(f"a document has {distinct} distinct terms, above max_terms {MAX_TERMS}")
                for j in range(0, len(found), TOKENS):
                    part = found[j : j + TOKENS]
                    at += [i] * len(part)
                    for x, y in zip(columns, zip(*part, strict=True), strict=True):
                        x.extend(y)
                    if len(at) >= TOKENS:
                        yield made(at, columns)
                        at, columns = [], ([], [], [], [])
            yield made(at, columns)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, term string, position int, start int, end int")


class Index:
    """``docs``: id, len. ``postings``: id, term, tf, positions. Queries are read by the tokenizer and form of the texts. ``unit``: what a fuzzy word's edits change, characters or (UTF-8) bytes."""

    def __init__(self, docs: DataFrame, postings: DataFrame, stop_words: bool = False, k1: float = K1, b: float = B, form: str | None = "NFC", tokenizer=None, unit: str = "characters"):
        if unit not in ("characters", "bytes"):
            raise ValueError("unit is characters or bytes")
        self.docs, self.postings, self.stop_words, self.k1, self.b, self.form, self.tokenizer, self.unit = docs, postings, stop_words, k1, b, form, tokenizer, unit
        self._size: tuple | None = None

    @classmethod
    def build(cls, df: DataFrame, id_col: str, text_col: str, stop_words: bool = False, form: str | None = "NFC", tokenizer=None, **options) -> Index:
        """Both tables are written to the shared folder: later searches read them, not the texts."""
        tokens = tokenize(df, id_col, text_col, stop_words, form, tokenizer)
        postings = cut_lineage(tokens.groupBy("id", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions")).sortWithinPartitions("term"))
        docs = cut_lineage(df.select(F.col(id_col).alias("id")).distinct().join(postings.groupBy("id").agg(F.sum("tf").alias("len")), "id", "left").select("id", F.coalesce("len", F.lit(0)).alias("len")))
        return cls(docs, postings, stop_words, form=form, tokenizer=tokenizer, **options)

    def _like(self, docs: DataFrame, postings: DataFrame) -> Index:
        return Index(docs, postings, self.stop_words, self.k1, self.b, self.form, self.tokenizer, self.unit)

    def words(self, text: str) -> list[tuple[str, int, int, int]]:
        return self.tokenizer(text) if self.tokenizer else words(text, self.stop_words, self.form)

    def terms(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def _wants(self, query: str | list) -> list[tuple]:
        """Clause number, terms (of a fuzzy clause its word), offsets (None: terms by themselves), slop, edits (None: not fuzzy)."""
        out = []
        for i, c in enumerate(parse(query) if isinstance(query, str) else dict.fromkeys(query)):
            own = self.words(c.text)
            if isinstance(c, Fuzzy):
                word = own[0][0] if own else ""
                out.append((i, [word], None, 0, auto_edits(word) if c.edits is None else c.edits))
            elif isinstance(c, Phrase) and len(own) > 1:
                out.append((i, [x[0] for x in own], [x[1] - own[0][1] for x in own], c.slop, None))
            elif own:
                out.append((i, list(dict.fromkeys(x[0] for x in own)), None, 0, None))
        return out

    def statistics(self, query: str | list) -> Statistics:
        """Of the query's terms alone: one row for each reaches the driver, EXPANSIONS + 1 for a fuzzy word."""
        if self._size is None:
            self._size = tuple(self.docs.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first())
        wants = self._wants(query)
        terms = dict.fromkeys((t for _, own, _, _, edits in wants if edits is None for t in own), 0)
        if terms:
            terms |= {x["term"]: x["df"] for x in self.terms().where(F.col("term").isin(list(terms))).collect()}
        near = {f"{own[0]}~{edits}": (edits, self._near(own[0], edits)) for _, own, _, _, edits in wants if edits is not None}
        cut = frozenset(w for w, (_, found) in near.items() if len(found) > EXPANSIONS)
        return Statistics(*self._size, terms, {w: (e, found[:EXPANSIONS]) for w, (e, found) in near.items()}, cut)

    def _near(self, word: str, edits: int) -> list[tuple[str, int, int]]:
        """Dictionary terms within ``edits`` of ``word``, one more than EXPANSIONS at most."""
        # An adjacent swap is one edit here and two to the engine's function, which leaves Python few terms.
        # Of bytes, each stands as the Latin-1 character of its number.
        own, of = (word, F.col("term")) if self.unit == "characters" else (word.encode().decode("latin-1"), F.decode(F.col("term").cast("binary"), "ISO-8859-1"))
        near = self.terms().withColumn("own", of).where(F.length("own").between(len(own) - edits, len(own) + edits) & (F.levenshtein("own", F.lit(own)) <= 2 * edits))

        @F.pandas_udf("int")
        def far(found: pd.Series) -> pd.Series:
            return found.map(lambda x: damerau(own, x, edits)).astype("int32")

        rows = near.withColumn("d", far("own")).where(F.col("d") <= edits).orderBy("d", F.desc("df"), "term").limit(EXPANSIONS + 1).collect()
        return [(x["term"], x["d"], x["df"]) for x in rows]

    def expansions(self, fuzzy: Fuzzy) -> list[tuple[str, int, float]]:
        """term, df, boost of up to 50 dictionary terms: nearest first, then most common, then by term."""
        (_, (word,), _, _, edits), *_ = self._wants([fuzzy])
        return [(t, n, _boost(word, t, d)) for t, d, n in self._near(word, edits)[:EXPANSIONS]]

    def _tf(self, tf: Column, length: Column, of: Statistics) -> Column:
        mean = of.length / of.docs if of.docs and of.length else 1.0
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / mean))

    def _weighed(self, weights: dict[str, float], of: Statistics) -> DataFrame:
        """id, term, score of each of these terms that a document has."""
        own = self.postings.where(F.col("term").isin(list(weights))).join(self.docs, "id")
        weight = F.element_at(F.create_map(*[F.lit(x) for t, w in weights.items() for x in (t, float(w))]), F.col("term")) if weights else F.lit(0.0)
        return own.select("id", "term", (weight * self._tf(F.col("tf"), F.col("len"), of)).alias("score"))

    def phrase_scores(self, terms: list[str], offsets: list[int], slop: int, of: Statistics) -> DataFrame:
        """id, score: a pseudo-term whose idf is the sum of its terms' and whose frequency counts matches."""
        distinct = list(dict.fromkeys(terms))
        held = self.postings.where(F.col("term").isin(distinct))
        joined = held.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("by")).where(F.size("by") == len(distinct))

        @F.pandas_udf("double")
        def frequency(by: pd.Series) -> pd.Series:
            def one(own):
                lists = [list(map(int, dict(own)[t])) for t in terms]
                return sloppy_frequency(terms, lists, offsets, slop) if slop else float(phrase_count(lists, offsets))

            return by.map(one).astype(float)

        found = joined.select("id", frequency("by").alias("tf")).where("tf > 0").join(self.docs, "id")
        idf = float(sum(of.idf(of.terms[t]) for t in terms))
        return found.select("id", (F.lit(idf) * self._tf(F.col("tf"), F.col("len"), of)).alias("score"))

    def scores(self, query: str | list, statistics: Statistics | None = None) -> DataFrame:
        """id, clause (a term, or the clause's number), score of every clause that matches.

        A fuzzy clause gives a document its best expansion; all of them score with the
        largest count among them.
        """
        of, wants = statistics or self.statistics(query), self._wants(query)
        try:
            single = {t: of.idf(of.terms[t]) for _, terms, offsets, _, edits in wants if offsets is None and edits is None for t in terms}
            out = self._weighed(single, of).select("id", F.col("term").alias("clause"), "score")
            for i, terms, offsets, slop, edits in wants:
                if offsets is not None and all(of.terms[t] for t in terms):
                    own = self.phrase_scores(terms, offsets, slop, of)
                elif edits is not None and (found := of.near[f"{terms[0]}~{edits}"][1]):
                    idf = of.idf(max(n for _, _, n in found))
                    own = self._weighed({t: idf * _boost(terms[0], t, d) for t, d, _ in found}, of).groupBy("id").agg(F.max("score").alias("score"))
                else:
                    continue
                out = out.unionByName(own.select("id", F.lit(f"#{i}").alias("clause"), "score"))
        except KeyError as e:
            raise ValueError("statistics of another query") from e
        return out

    def search(self, query: str | list, k: int, keep: Column | None = None, live: DataFrame | None = None, statistics: Statistics | None = None) -> DataFrame:
        """id, score of the k best, by (score, id). ``keep``: which ids may be hits, statistics unchanged; ``live``: id, documents that still exist; ``statistics``: of the whole collection, where this index is a part."""
        found = self.scores(query, statistics)
        if keep is not None:
            found = found.where(keep)
        found = found.groupBy("id").agg(F.sum("score").alias("score"))
        if live is not None:
            found = found.join(live.select("id"), "id", "left_semi")
        return found.orderBy(F.desc("score"), "id").limit(k)

    def highlight(self, hits: DataFrame, text_col: str, query: str | list, most: int = 160, statistics: Statistics | None = None) -> DataFrame:
        """``hits`` with matches (start, end: bytes of the text; clause: its number in the query; occurrence) of words, phrases and fuzzy words, and snippet."""
        wants = self._wants(query)
        near = (statistics or self.statistics(query)).near if any(x[4] is not None for x in wants) else {}
        each = [(i, terms if edits is None else [t for t, _, _ in near[f"{terms[0]}~{edits}"][1]], offsets, slop) for i, terms, offsets, slop, edits in wants]
        return _marked(hits, text_col, each, most, self.stop_words, self.form, self.tokenizer)

    def verify(self, df: DataFrame, id_col: str, text_col: str) -> dict:
        """Postings that the texts don't have, and those that the index lacks."""
        key = ["id", "term", "tf"]
        own = tokenize(df, id_col, text_col, self.stop_words, self.form, self.tokenizer).groupBy("id", "term").agg(F.count("*").alias("tf"))
        # Texts are read once; a row says how often each side has it.
        both = own.select(*key, F.lit(1).alias("own"), F.lit(0).alias("held")).unionByName(self.postings.select(*key, F.lit(0).alias("own"), F.lit(1).alias("held")))
        sides = both.groupBy(*key).agg(F.sum("own").alias("own"), F.sum("held").alias("held"))
        missing, stale = sides.agg(F.coalesce(F.sum(F.when(F.col("held") == 0, F.col("own"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("own") == 0, F.col("held"))), F.lit(0))).first()
        return {"missing": missing, "stale": stale}

    def without(self, ids: DataFrame) -> Index:
        """The index after the documents in ``ids`` (id) are deleted."""
        return self._like(self.docs.join(ids, "id", "left_anti"), self.postings.join(ids, "id", "left_anti"))

    def with_documents(self, df: DataFrame, id_col: str, text_col: str) -> Index:
        """The index after documents are put: they replace those with their ids."""
        own = Index.build(df, id_col, text_col, self.stop_words, self.form, self.tokenizer)
        rest = self.without(own.docs.select("id"))
        return self._like(cut_lineage(rest.docs.unionByName(own.docs)), cut_lineage(rest.postings.unionByName(own.postings)))


def _boost(word: str, term: str, distance: int) -> float:
    return 1 - distance / max(1, min(len(word), len(term)))


def _marked(hits: DataFrame, text_col: str, wants: list[tuple], most: int, stop_words: bool, form: str | None, tokenizer) -> DataFrame:
    @F.pandas_udf("matches array<struct<start:int,end:int,clause:int,occurrence:int>>, snippet string")
    def mark(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            text = text or ""
            # Places are bytes of the text as it is; a term's form is the index's.
            own = tokenizer(text) if tokenizer else [(unicodedata.normalize(form, t) if form else t, *x) for t, *x in words(text, stop_words, None)]
            found = found_clauses(own, wants)
            a, b = snippet(text, [x[:3] for x in found], most)
            out.append(([dict(zip(("start", "end", "clause", "occurrence"), x, strict=True)) for x in found], text.encode()[a:b].decode()))
        return pd.DataFrame(out, columns=["matches", "snippet"])

    own = "__marked"
    return hits.withColumn(own, mark(F.col(text_col).cast("string"))).select(*[F.col(f"`{x}`") for x in hits.columns], f"{own}.matches", f"{own}.snippet")


def highlight(hits: DataFrame, text_col: str, terms: list[str], most: int = 160, stop_words: bool = False) -> DataFrame:
    """``hits`` with matches (start, end, clause: the term's place in ``terms``, occurrence) and snippet; without an index."""
    return _marked(hits, text_col, [(i, [t], None, 0) for i, t in enumerate(terms)], most, stop_words, "NFC", None)
