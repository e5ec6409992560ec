"""The stages of the corpus pipeline, each against a brute-force version on its own input."""

import random
import re

import corpus_pipeline
from crossrank.llm import quality_classifier, shingle_join

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "source_mixing":
            assert after.columns == columns
        seen[name] = (docs.toPandas(), after.toPandas())
        docs = after

    before, after = seen["quality_classifier"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    known = [i for i in before["doc_id"] if i in labels.index]
    kept = set(after["doc_id"])
    assert sum((i in kept) == bool(labels[i]) for i in known) >= 0.95 * len(known)

    before, after = seen["line_dedup"]
    sites, owner = {}, {}
    normal = lambda x: " ".join(x.lower().split())
    for r in before.itertuples():
        for line in r.text.split("\n"):
            sites.setdefault(normal(line), set()).add(r.source)
            owner[normal(line)] = min(r.doc_id, owner.get(normal(line), r.doc_id))
    want = {}
    for r in before.itertuples():
        lines, used = [], set()
        for line in r.text.split("\n"):
            k = normal(line)
            common = len(k.split()) >= 4 and len(sites[k]) >= 8
            if not common or (owner[k] == r.doc_id and k not in used):
                lines.append(line)
            used.add(k)
        text = "\n".join(lines)
        if text == r.text or text.strip():
            want[r.doc_id] = text
    assert dict(zip(after["doc_id"], after["text"])) == want

    before, after = seen["ngram_jaccard_join"]
    sets = {}
    for r in before.itertuples():
        w = r.text.lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    smallest = {i: i for i in sets}
    for _ in range(20):
        for i in sets:
            for j in sets:
                o = len(sets[i] & sets[j])
                if o and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                    smallest[i] = min(smallest[i], smallest[j])
    assert sorted(after["doc_id"]) == sorted(i for i in smallest if smallest[i] == i)

    before, after = seen["benchmark_decontamination"]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = set()
    for text in spark.read.parquet(f"{FOLDER}/benchmark.parquet").toPandas()["text"]:
        w = split(text)
        windows |= {" ".join(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    clean = [
        r.doc_id for r in before.itertuples()
        if not any(f" {x} " in f" {' '.join(split(r.text))} " for x in windows)
    ]
    assert sorted(after["doc_id"]) == sorted(clean)

    before, after = seen["source_mixing"]
    total = before["text"].map(lambda t: len(t.split())).sum()
    mixed = after["text"].map(lambda t: len(t.split())).sum()
    assert set(after["doc_id"]) <= set(before["doc_id"])
    assert after["copy"].max() <= 3 and mixed <= 3 * total


def test_stages_keep_odd_rows(spark):
    """Nulls, empty texts, repeated rows and unknown columns pass every stage."""
    rows = [(None, None, "en", None, 0, 1), (1, None, "en", "a", 0, 1), (2, "", "en", "a", 0, 1), (3, "x y z", "en", None, 0, 1)]
    rows += [(4, "some words that are there twice", "en", "b", 0, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, FOLDER)
        assert set(docs.columns) <= set(got.columns)
        n = got.count()
        assert n == (5 if name == "ngram_jaccard_join" else n) and n <= 3 * len(rows)
        assert stage(spark, empty, FOLDER).count() == 0


def test_training_skips_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality_classifier.training_rows(docs, labels)
    held = docs.where(quality_classifier.held_out(docs["doc_id"])).select("doc_id").toPandas()["doc_id"]
    assert rows and not {r["doc_id"] for r in rows} & set(held)


ADDED = "n_lines n_removed copy kept_id id row order text_key comp key n sig u v first score label label_id __row __copy h size".split()


def test_stages_pass_clashing_columns_on(spark):
    """Columns named like anything a stage adds or uses inside keep their values."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = "this line of the site stands on each and every page"
    texts = [" ".join(word() for _ in range(40)) + (f"\n{line}" if i % 2 else "") for i in range(24)]
    rows = [(i, t, f"s{i % 12}", *[f"{c}{i}" for c in ADDED]) for i, t in enumerate(texts + texts[:3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in ADDED))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, FOLDER).toPandas()
        assert len(got) > 0 and set(got.columns) == set(docs.columns)
        for c in ADDED:
            if not (name == "source_mixing" and c == "copy"):
                assert all(v == f"{c}{i}" for v, i in zip(got[c], got["doc_id"])), (name, c)


def test_keep_one_tells_texts_of_one_id_apart(spark):
    rng = random.Random(6)
    a, b = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for _ in range(2))
    docs = spark.createDataFrame([(3, a, "x"), (5, a, "y"), (5, b, "z"), (None, b, "w"), (None, None, "v")], "doc_id long, text string, source string")
    got = {tuple(r) for r in shingle_join.keep_one(docs).collect()}
    assert got == {(3, a, "x"), (5, b, "z"), (None, None, "v")}


def test_training_rows_are_bounded_per_id(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7} of this id") for i in range(5000)] + [(2, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(quality_classifier.training_rows(docs, labels, max_rows=10)) == 2
