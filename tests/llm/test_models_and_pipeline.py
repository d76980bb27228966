"""op9 and op10 on held-out rows; the pipeline against its parts done plainly."""

import hashlib
from zlib import crc32

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from plinth.llm import quality_model as M
from plinth.llm import toxicity as T
from plinth.llm.queries import QUERIES
from test_decontaminate import brute as leaks
from test_secret_scan import all_spans
from test_simhash import brute as copies

SF = "/root/testdata/sf0.01"


def test_op9_held_out_accuracy(spark):
    rows = QUERIES["op9_quality_model"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pairs = [a > b for a, x in held if x for b, y in held if not y]
    assert np.mean(pairs) > 0.95 and np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.9


def test_machine_scores_all_pairs():
    rnd = np.random.default_rng(0)
    m = M.Machine(0.3, rnd.normal(size=M.SIZE), rnd.normal(size=(M.SIZE, M.RANK)))
    idx, val = np.array([3, 9, 40, 77]), np.array([0.5, 2.0, -1.0, 1.0])
    plain = m.bias + m.linear[idx] @ val + sum(m.factors[idx[a]] @ m.factors[idx[b]] * val[a] * val[b] for a in range(4) for b in range(a))
    assert abs(m.logits(np.array([0, 4]), idx, val)[0] - plain) < 1e-9


def test_models_edges(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "", 0), (1, "", 0), (2, "good words here", 5), (3, "BAD!! BAD!! " * 30000, 5)], "doc_id long, text string, n_chars long").selectExpr("*", "1 as score", "true as is_toxic")
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 0), (2, 1, 0), (3, 0, 1), (None, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    for made in (M.quality(docs, labels), T.toxicity(docs, labels)):
        assert made.count() == 5
    for fn in (M.quality, T.toxicity):
        assert fn(docs, labels.limit(0)).count() == 5 and fn(docs.limit(0), labels).count() == 0
    assert {r.score for r in M.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert not any(r.is_toxic for r in T.toxicity(docs, labels.limit(0)).collect())
    assert M.quality(docs.drop("n_chars"), labels).count() == 5


def test_op10_finds_toxic_documents(spark):
    rows = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    toxic = [rows[r.doc_id].is_toxic for r in labels if r.toxic]
    clean = [rows[r.doc_id].is_toxic for r in labels if not r.toxic]
    assert len(rows) == 10000 and np.mean(toxic) > 0.93 and np.mean(clean) < 0.005


def test_op10_on_rows_it_never_saw(spark):
    """Fitted without the doc_ids whose crc32 is divisible by 5, graded on those."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    unseen = labels.where("crc32(cast(doc_id as string)) % 5 = 0")
    chain = T.train(docs, labels.join(unseen, "doc_id", "left_anti"))
    got = T.score(docs.join(unseen, "doc_id"), chain).select("toxic", "is_toxic").collect()
    toxic, clean = [r.is_toxic for r in got if r.toxic], [r.is_toxic for r in got if not r.toxic]
    print("held out:", len(toxic), np.mean(toxic), len(clean), np.mean(clean))
    assert len(toxic) > 80 and np.mean(toxic) > 0.85 and np.mean(clean) < 0.005


def test_a_sample_has_one_row_a_doc_id(spark):
    from plinth.llm.labelled import sample

    docs = spark.createDataFrame([(1, f"text {i % 50}", i) for i in range(400)] + [(2, "b", 0)], "doc_id long, text string, extra int")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    got = sample(docs, labels, ["toxic"], 10, train_only=False, keep=("extra",)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2] and sample(docs.orderBy("extra"), labels, ["toxic"], 10, train_only=False, keep=("extra",)).collect()[0].asDict().keys() == {"doc_id", "text", "extra", "y_toxic"}


def test_chain_uses_out_of_fold_predictions_and_order():
    rnd = np.random.default_rng(3)
    rows = T.Rows.of([np.array(sorted(rnd.choice(40, 8, replace=False))) for _ in range(400)])
    first = np.array([3 in rows.idx[rows.ptr[i] : rows.ptr[i + 1]] for i in range(400)])
    chain = T.fit_chain(rows, np.column_stack([first, first]).astype(float), np.arange(400) % 4)
    p = T.predict_chain(chain, rows)
    assert len(chain[0].dense) == 0 and len(chain[1].dense) == 1 and chain[1].dense[0] > 0
    assert ((p > 0.5) == first[:, None]).all()


def test_op9_scores_by_plain_sums(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = M.train(docs, labels)
    texts = {r.doc_id: r for r in docs.collect()}
    for r in M.score(docs.limit(40), m).collect():
        idx, val = (x.tolist() for x in M.features(texts[r.doc_id].text, texts[r.doc_id].n_chars))
        z = float(m.bias) + sum(float(m.linear[i]) * v for i, v in zip(idx, val))
        for f in range(M.RANK):
            column = [float(m.factors[i, f]) * v for i, v in zip(idx, val)]
            z += sum(a * b for k, a in enumerate(column) for b in column[:k])
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-3


def test_op10_chain_by_plain_sums(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = T.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in T.score(docs.limit(60), chain).collect():
        seen = []
        for model in chain:
            weight = dict(zip(model.at.tolist(), model.weights.tolist()))
            z = model.bias + sum(weight.get(b, 0.0) for b in T.buckets(texts[r.doc_id]).tolist()) + sum(w * p for w, p in zip(model.dense, seen))
            seen.append(1 / (1 + np.exp(-z)))
        assert np.allclose(seen, [r[f"p_{c}"] for c in T.CATEGORIES]) and r.is_toxic == (seen[-1] >= T.THRESHOLD)


def test_grades_of_a_fold_do_not_look_at_its_labels():
    rnd = np.random.default_rng(5)
    rows = T.Rows.of([np.array(sorted(rnd.choice(60, 9, replace=False))) for _ in range(300)])
    toxic, folds = rnd.random(300) < 0.3, np.arange(300) % 4
    other = np.where(folds == 1, ~toxic, toxic)
    a, b = (T.graded(rows, y, folds != 1)[folds != 1] for y in (toxic, other))
    assert (a == b).all() and a[:, 0].any()


def test_odd_rows_through_the_whole_chain(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    spaceless = "".join(chr(0x4E00 + i % 9000) for i in range(60000))
    texts = [(1, None), (2, ""), (3, "one text of a few words that stays as it is"), (3, "one text of a few words that stays as it is"), (None, "nameless words that stand here by themselves"), (4, "before " * 3 + item), (5, "token = abcdefgh12345 and more"), (6, spaceless), (7, "word " * 90000)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, tag string, row int, secret_spans int, __text string, token_ids string, is_toxic string, decoded string"
    docs = spark.createDataFrame([(i, t, None, "s", None, "x", 1, 2, "y", "z", "w", "v") for i, t in texts], columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.schema.names == [c.split()[0] for c in columns.split(", ")], name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = {r.doc_id: r for r in docs.collect()}
    assert len(left) == docs.count() and set(left) == {1, 3, None, 5, 6, 7}  # 1 and 2 are one group, 4 holds an item
    assert left[1].text is None and left[5].text == "[SECRET] and more" and (left[5].tag, left[5].n_chars, left[5]["__text"], left[5].is_toxic) == ("x", 17, "y", "w")
    last = corpus_pipeline.STAGES[-1][1]
    got = {r.doc_id: r for r in last(spark, docs, str(tmp_path)).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in left.items():
        assert list(got[i].token_ids) == library.encode(r.text or "", add_special_tokens=False).ids and got[i].n_tokens == len(got[i].token_ids)
    assert last(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_against_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in T.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    left = [(i, r.text) for i, r in sorted(rows.items()) if not r.is_toxic]
    left = [(i, dict(left)[i]) for i, _, c in copies(left) if i == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {x[0] for x in leaks(left, items)}
    want = {}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in left:
        if i not in dirty:
            out, at = [], 0
            for a, _, b in all_spans(text):
                if a >= at:
                    out += [text[at:a], "[SECRET]"]
                at = max(at, b)
            ids = library.encode("".join([*out, text[at:]]), add_special_tokens=False).ids
            want[i] = (len(ids), ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, list(r.token_ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and len(got) < docs.count()


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.names == docs.schema.names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontaminate", "secrets", "bpe"]
