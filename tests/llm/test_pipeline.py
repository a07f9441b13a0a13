"""The pipeline: every stage on its own input, and the whole."""

from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from test_near_dup import brute_classes, brute_fingerprint

from cellweave.llm import linededup, mixing, quality
from cellweave.llm.encoders import ByteBpe


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "mixing", "best_fit_packing"]

    good = stages["quality_rules"](spark, docs, sf)
    kept = {x["doc_id"] for x in quality.judge(docs).collect() if x["kept"]}
    assert good.columns == columns and {x["doc_id"] for x in good.collect()} == kept

    lines = stages["line_dedup"](spark, good, sf)
    rows = lines.collect()
    assert lines.columns == columns and all(x["n_chars"] == len(x["text"]) for x in rows)
    assert {x["doc_id"] for x in rows} <= kept

    near = stages["near_dedup"](spark, lines, sf)
    left = near.collect()
    of = brute_classes({brute_fingerprint(x["text"]) for x in rows})
    assert near.columns == columns and len(left) == len(set(of.values()))
    assert {of[brute_fingerprint(x["text"])] for x in left} == set(of.values())

    mixed = stages["mixing"](spark, near, sf)
    taken = sum(x["taken"] for x in mixing.mix(near).collect())
    assert mixed.columns == columns and sum(len(x["text"].encode().split()) for x in mixed.collect()) == taken

    packed = stages["best_fit_packing"](spark, mixed, sf).collect()
    bpe = ByteBpe("byte_bpe_50k.json")
    assert sum(x["length"] for x in packed) == sum(len(bpe.encode([x["text"]])[0]) // 4 + 1 for x in mixed.collect())


def brute_lines(rows):
    """Texts by id after the line stage, in plain Python. ``rows``: id (distinct), text."""
    held = []
    for i, text in rows:
        for at, line in enumerate(text.split("\n")):
            raw = line.translate(str.maketrans("\t\x0b\f\r", "    ")).strip(" ")
            if raw:
                tokens = tuple("<*>" if set(x) & set("0123456789") else x for x in raw.split(" ") if x)
                held.append((i, text, at, raw, tokens, (len(tokens), tokens[: linededup.LEADING])))
    by_leaf, by_tokens, support = defaultdict(set), defaultdict(set), Counter()
    for _, text, _, _, tokens, leaf in held:
        by_leaf[leaf].add(text)
        by_tokens[leaf, tokens].add(text)
    for (leaf, tokens), of in by_tokens.items():
        for p, x in enumerate(tokens):
            support[leaf, p, x] += len(of)

    def template(raw, tokens, leaf):
        often = [support[leaf, p, x] >= linededup.DOCS for p, x in enumerate(tokens)]
        if sum(o and x != "<*>" for o, x in zip(often, tokens, strict=True)) < linededup.SIMILAR * len(tokens):
            return leaf, raw
        return leaf, tuple(x if o else "<*>" for o, x in zip(often, tokens, strict=True))

    shared, places = defaultdict(set), defaultdict(list)
    for i, text, at, raw, tokens, leaf in held:
        keys = [("template", template(raw, tokens, leaf))] if len(by_leaf[leaf]) >= linededup.DOCS else []
        keys += [("passage", " ".join(raw.split()))] if len(tokens) >= linededup.PASSAGE else []
        for key in keys:
            shared[key].add(text)
            places[key].append((i, at))
    gone = set()
    for key, of in shared.items():
        if len(of) >= (linededup.DOCS if key[0] == "template" else 2):
            first = min(i for i, _ in places[key])
            gone |= {(i, at) for i, at in places[key] if i != first}
    worded = defaultdict(set)
    for i, _, at, *_ in held:
        worded[i].add(at)
    return {i: "\n".join(x for at, x in enumerate(text.split("\n")) if (i, at) not in gone) for i, text in rows if not worded[i] or any((i, at) not in gone for at in worded[i])}


def test_line_stage_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = list({x["doc_id"]: (x["doc_id"], x["text"]) for x in docs.collect() if x["doc_id"] is not None and x["text"] is not None}.values())
    start = max(i for i, _ in rows) + 1
    passage = " ".join(f"shared{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    planted = [f"{chr(97 + i) * 9} words of its own\n{passage}  \nuser u{i} logged in from host h{i % 7} again\n\tend" for i in range(25)]
    planted += [passage, "  " + passage.replace(" ", "  "), passage[:-1], "", " \n\n", "user u3 logged in from host h9 again"]
    rows += [(start + i, x) for i, x in enumerate(planted)]
    like = spark.createDataFrame([(i, x, "en", "h", len(x)) for i, x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {x["doc_id"]: x["text"] for x in dict(pipeline.STAGES)["line_dedup"](spark, like, "").collect()}
    want = brute_lines(rows)
    assert got == want
    assert passage in got[start] and got[start + 1] == "bbbbbbbbb words of its own" and start + 25 not in got and start + 27 in got


def test_run(spark, sf):
    rows = pipeline.run(spark, sf).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
    again = pipeline.run(spark, sf).collect()
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(x[k] for k in key) for x in rows) == sorted(tuple(x[k] for k in key) for x in again)


def test_odd_documents(spark, odd, none):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars", "kept", "size"), none):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            docs = out
        pipeline.STAGES[-1][1](spark, docs, "").collect()


def test_quality_stage_removes_lines(spark):
    own = [" ".join(f"d{i}w{j}" for j in range(60)) for i in range(20)]
    docs = spark.createDataFrame([(i, f"{x}\nshared footer line", "en", "h", 0) for i, x in enumerate(own)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = dict(pipeline.STAGES)["quality_rules"](spark, docs, "")
    assert sorted((x["doc_id"], x["text"], x["n_chars"]) for x in got.collect()) == [(i, x, len(x)) for i, x in enumerate(own)]
