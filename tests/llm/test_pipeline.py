import random

import corpus_pipeline
from tests.llm.test_dedup import closure, plain_jaccard
from tests.llm.test_text import brute_pieces, check_packed


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocab = {"en": "the of and with tion ing that".split(), "de": "der und nicht ung schen ver".split()}
    rows = []
    for k in range(120):
        lang = ("en", "de")[k % 2]
        rows.append((k, " ".join(rng.choice(vocab[lang]) + rng.choice(vocab[lang]) for _ in range(rng.randrange(20, 400))), lang, "s", 1))
    rows += [(200 + k, rows[k][1], rows[k][2], "s", 1) for k in range(10)]
    rows += [(400 + k, rows[k][1] + " und so weiter", rows[k][2], "s", 1) for k in range(20, 50)]
    rows += [(300, None, None, None, None), (301, "12 $$ 34", "en", "s", 1), (302, "", "de", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    keep = {}
    for i, t, *_ in rows:
        if t and any(c.isalpha() for c in t):
            keep[t] = max(i, keep.get(t, -1))
    order = sorted((i, t) for t, i in keep.items())
    comp = closure(len(order), lambda i, j: plain_jaccard(order[i][1], order[j][1]) >= 0.8)
    assert len(order) - 30 <= len(set(comp)) <= len(order) - 25
    texts = {order[k][0]: order[k][1] for k in set(comp)}
    want = {(i, p): v for i, t in texts.items() for (_, p), v in brute_pieces([t]).items()}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    check_packed(got)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]
