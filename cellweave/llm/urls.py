"""URL filter: rules first, else naive Bayes over segmented host and path words.

Unigrams are counted over the visible words of every page. Names, the runs of letters
in hosts and paths, are looked up once each: those of their parts that are words, whatever
their rank, come by a join, and Viterbi splits the name into the likeliest words. The
classifier is multinomial naive Bayes over those words, trained on every url: those
with a seed word are the blocked class, the others the allowed one. Its model is a table
with a row for each word, and a url's score is the sum of its names' scores, so neither
words nor weights are sent to the driver or to every worker. Weights are whole billionths:
their sums don't depend on the order of the rows.

Defined cases: a null url, or one without "://", has empty host and path, fits
no rule and is judged by the classes' shares alone (allowed); null html counts no
words; a url of any length is split whole, each name in one task; repeated rows are judged
each; null ids are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, slices, staged, texts

#: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of hosts and paths that mark a training url as one to block.
SEEDS = ("ads", "adult", "bet", "bets", "betting", "casino", "gambling", "pharmacy", "pills", "poker", "porn", "sex", "slots", "spam", "track", "tracker", "tracking", "viagra", "xxx")
#: Letters of the longest word that a name is split into; longer runs of unknown letters are split up.
LONGEST_WORD = 24
#: Occurrences that a seed word has beside those counted, so that it can be split off.
SEED_COUNT = 50
#: Count of a token that a class never had.
SMOOTHING = 0.1
#: Places of a name whose parts are cut at once, and parts in a batch, about.
PLACES, PARTS = 1 << 12, 1 << 16
#: Weights are whole numbers of this part of one.
SCALE = 1_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for what, at, under in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        name, verdict = F.when(fits, F.lit(at + under)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def names(urls: DataFrame, *more: str) -> DataFrame:
    """row, ``more``, key: a row for each name of a url, h: those of its host, p: those of its path; digits and signs only separate."""

    def found(text: Column, kind: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1)), lambda x: F.concat(F.lit(kind), x))

    return urls.select("row", *more, F.explode(F.concat(found(F.col("host"), "h:"), found(F.lower("path"), "p:"))).alias("key"))


def parts(keys: DataFrame) -> DataFrame:
    """key, part: the strings of up to LONGEST_WORD letters that can be words of a name."""

    def cut(batches):
        owners, found = [], []
        for batch in slices(batches):
            for key in texts(batch.column(0)):
                n = len(key)
                for at in range(2, n, PLACES):
                    own = {key[i:j] for i in range(at, min(n, at + PLACES)) for j in range(i + 1, min(n, i + LONGEST_WORD) + 1)}
                    owners += [key] * len(own)
                    found += own
                    if len(found) >= PARTS:
                        yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(found, pa.string())], ["key", "part"])
                        owners, found = [], []
        yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(found, pa.string())], ["key", "part"])

    return keys.select("key").mapInArrow(cut, "key string, part string")


def unigrams(pages: DataFrame, html_col: str = "html") -> tuple[DataFrame, int]:
    """word, count of all pages' visible text; the number of all."""
    shown = F.regexp_replace(F.lower(F.col(html_col).cast("string")), r"<(script|style)[^>]*>[\s\S]*?</\1>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(shown, r"[^\p{L}]+")).alias("word")).where(F.length("word").between(1, LONGEST_WORD))
    counts = staged(words.groupBy("word").agg(F.count("*").alias("count")), "words")
    return counts, counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]


class Segmenter:
    """Splits names into the words of greatest product of unigram probabilities."""

    def __init__(self, counts: dict[str, int], seeds=SEEDS, total: int | None = None):
        """``total``: of all words' counts, where ``counts`` are some words'."""
        more = 0 if total is None else total - sum(counts.values())
        counts = dict(counts)
        for x in seeds:
            counts[x] = counts.get(x, 0) + SEED_COUNT
        total = sum(counts.values()) + more + 1
        self.cost = {w: log(total / n) for w, n in counts.items()}
        self.unknown = log(total)

    def _cost(self, word: str) -> float:
        """A string that is no word costs more with each letter."""
        return self.cost.get(word, self.unknown + 2.5 * len(word))

    def words(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            cost, at = min((best[i] + self._cost(name[i:end]), i) for i in range(max(0, end - LONGEST_WORD), end))
            best.append(cost)
            back.append(at)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(out))


def segment(urls: DataFrame, counts: DataFrame, total: int, seeds=SEEDS) -> DataFrame:
    """key, n (its occurrences), tokens, marked (whether a token is a seed word): a row for each distinct name."""
    keys = staged(names(urls).groupBy("key").agg(F.count("*").alias("n")), "names")
    held = parts(keys).groupBy("part").agg(F.count("*").alias("n"))
    known = staged(counts.join(held, F.col("word") == F.col("part")).select("part", "n", "count"), "parts")
    pairs = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Of one name: its parts that are words.
    own = join_hot(parts(keys), known, "part", pairs).groupBy("key").agg(F.collect_list("part").alias("part"), F.collect_list("count").alias("count"))

    def split(batches):
        for batch in slices(batches):
            tokens, marked = [], []
            for key, part, count in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                found = Segmenter(dict(zip(part or (), count or (), strict=True)), seeds, total).words(key[2:])
                tokens.append([key[:2] + x for x in found])
                marked.append(any(x in seeds for x in found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(tokens, pa.list_(pa.string())), pa.array(marked, pa.bool_())], ["key", "n", "tokens", "marked"])

    return staged(keys.join(own, "key", "left").mapInArrow(split, "key string, n long, tokens array<string>, marked boolean"), "segmented")


def _sum(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]


def labelled(urls: DataFrame, segmented: DataFrame) -> DataFrame:
    """``urls`` with bad: whether a name holds a seed word."""
    marks = segmented.where("marked").select("key", "n")
    hits = join_hot(names(urls), marks, "key", _sum(segmented, "n")).select("row").distinct().withColumn("hit", F.lit(True))
    return staged(urls.join(hits, "row", "left").withColumn("bad", F.col("hit").isNotNull()).drop("hit"), "labelled")


def weigh(urls: DataFrame, segmented: DataFrame, train: Column | None = None) -> tuple[DataFrame, float]:
    """``urls``: with bad. token, n (names' tokens), weight (of 1 / SCALE); what a url without tokens scores.

    ``train``: the rows that are counted, all where it is null; tokens of the others
    alone weigh what one that no class had does.
    """
    use = F.lit(True) if train is None else train
    rows = urls.withColumn("use", use)
    by_key = names(rows, "bad", "use").groupBy("key").agg(F.count_if("use").alias("every"), F.count_if(F.col("use") & F.col("bad")).alias("blocked"))
    tokens = segmented.join(by_key, "key").select("every", "blocked", F.explode("tokens").alias("token"))
    tokens = staged(tokens.groupBy("token").agg(F.sum("every").alias("every"), F.sum("blocked").alias("blocked"), F.count("*").alias("n")), "tokens")
    kinds, every, blocked = tokens.agg(F.count_if(F.col("every") > 0), F.coalesce(F.sum("every"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    bad, all_rows = rows.agg(F.count_if(F.col("use") & F.col("bad")), F.count_if("use")).first()
    more = SMOOTHING * (kinds + 1)
    weight = F.log((F.col("blocked") + SMOOTHING) / F.lit(blocked + more)) - F.log((F.col("every") - F.col("blocked") + SMOOTHING) / F.lit(every - blocked + more))
    return tokens.select("token", "n", F.round(weight * SCALE).cast("long").alias("weight")), log((bad + 1) / (all_rows - bad + 1))


def scored(urls: DataFrame, segmented: DataFrame, weights: DataFrame, prior: float, hidden=()) -> DataFrame:
    """``urls`` with score: over 0 where the blocked class is the likelier. ``hidden``: words that don't count."""
    tokens = segmented.select("key", F.col("n").alias("times"), F.explode("tokens").alias("token"))
    if hidden:
        tokens = tokens.where(~F.substring("token", 3, LONGEST_WORD).isin(list(hidden)))
    each = join_hot(tokens, weights, "token", _sum(weights, "n")).groupBy("key").agg(F.first("times").alias("n"), F.sum("weight").alias("weight"))
    each = staged(each, "name-scores")
    found = join_hot(names(urls), each, "key", _sum(each, "n")).groupBy("row").agg(F.sum("weight").alias("weight"))
    score = F.lit(prior) + F.coalesce("weight", F.lit(0)) / F.lit(float(SCALE))
    return urls.join(found, "row", "left").withColumn("score", score).drop("weight")


def _urls(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    host, path = host_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return staged(urls.withColumn("row", F.monotonically_increasing_id()), "urls")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, seeds=SEEDS) -> DataFrame:
    """Per row page_id, host, path, rule, verdict, score (the classifier's)."""
    urls = _urls(pages, id_col, url_col)
    segmented = segment(urls, *unigrams(pages, html_col), seeds)
    urls = labelled(urls, segmented)
    found = scored(urls, segmented, *weigh(urls, segmented))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def held_out(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seeds=SEEDS, split=("host",)) -> DataFrame:
    """bad, blocked, n: how the classifier judges one half of the urls with their seed words hidden, trained on the other half; those equal in ``split`` (host, path) are in one half."""
    urls = _urls(pages, id_col, url_col)
    segmented = segment(urls, *unigrams(pages, html_col), seeds)
    urls = labelled(urls, segmented)
    train = F.pmod(F.xxhash64(*split), F.lit(2)) == 0
    found = scored(urls, segmented, *weigh(urls, segmented, train), hidden=seeds).where(~train)
    return found.groupBy("bad", (F.col("score") > 0).alias("blocked")).agg(F.count("*").alias("n"))


#: Host, path and rule of the op6 query in DuckDB, on the rows of pages.
RULES_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
)
SELECT page_id, host, path, (
  SELECT max_by(h || p, length(h || p)) FROM (VALUES {rules}) AS r(h, p)
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule
FROM s
""".format(rules=", ".join(f"('{at}', '{under}')" for _, at, under in RULES))
