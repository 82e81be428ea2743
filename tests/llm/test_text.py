import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from shoal.llm import bpe, bytesplit, chat, language, lbltree, logbilinear, packing, tokencount, wordbpe

DOCS = "doc_id long, text string, lang string, source string, ids string, word int, _id int"
ODD = [
    None, "", "a", " ", "  a  b ", "x\n\n y \n z", "it's 'tis don''t 'LL we've  'll", "日本語 テスト ½²    x", "é\x85 a\xa0b 　", "a" * 5000, "ab" * 700 + "  " + "\n" * 50 + "q", " " * 300, "\x1c a\x1db  \x1e",
    "😀😀 x😀", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|startoftext|> <|ENDOFTEXT|>", "theth" * 1500, "İstanbul ΣΑΣ ΟΔΟΣ ﬁn ǅ K Å é", "$$$ ### %%%", "a", "a",
]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    bits = ["a", "the", " ", "  ", "\n", "'s", "'", "é", "1", "!", "\xa0", "th", " x", "Foo"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", "i", 1, 2) for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def gpt():
    with open(bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_units_rebuild_and_split_alike():
    import regex

    for t in fuzz(500) + [x for x in ODD if x is not None]:
        u = bytesplit.units(t)
        assert " ".join(u) == t
        whole = regex.findall(bytesplit.PATTERN, t)
        assert whole == [p for k, x in enumerate(u) for p in regex.findall(bytesplit.PATTERN, " " * (k > 0) + x)]


def test_bpe_like_the_library(spark, gpt):
    texts = ODD + fuzz(300)
    got = {r["doc_id"]: r for r in bpe.digests(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        ids = gpt.encode_ordinary(t or "")
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_round_trip_through_tables(spark):
    texts = ODD + fuzz(30)
    out = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(bpe.encode(docs(spark, texts))).collect()}
    assert out == {k: (t or "").encode() for k, t in enumerate(texts)}


def test_empty_and_repeated_rows(spark):
    none, twice = docs(spark, []), docs(spark, ["a b", "a b"]).replace(1, 0, "doc_id")
    for made in (bpe.digests, tokencount.count_tokens, bpe.encode, packing.pieces):
        assert made(none).count() == 0 and len({tuple(map(str, r)) for r in made(twice).collect()}) == 1 and made(twice).count() == 2


def test_segment_tree_on_long_piece(gpt):
    rng = random.Random(4)
    piece = "".join(rng.choice("abcdeth") for _ in range(6000)).encode()
    ids = np.frombuffer(bpe.merge_all([piece], bpe.Ranks())[0], "<u4").tolist()
    assert ids == gpt.encode_ordinary(piece.decode())


def test_counts_like_the_library(spark):
    lib = Tokenizer.from_file(tokencount.VOCABULARY)
    rng = random.Random(4)
    texts = ODD + fuzz(300) + ["".join(rng.choice("abcdeth") for _ in range(9000)), "\n" * 4000]
    got = {r["doc_id"]: r for r in tokencount.count_tokens(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((t or "").encode()), n, n > 512)


def test_transducer_starts_again_at_its_bound(monkeypatch):
    monkeypatch.setattr(tokencount, "_STATES", 50)
    lib, c = Tokenizer.from_file(tokencount.VOCABULARY), tokencount.Counter()
    for t in fuzz(40) + ["internationalisation of words"]:
        assert c.count([t])[0] == len(lib.encode(t, add_special_tokens=False).ids)


def test_scan_composes():
    maps = [np.array(x) for x in ([[0, -1], [3, 4], [5, 6]], [[3, -1], [6, 5], [2, 9]], [[4, 0], [-1, 7], [1, 2]])]
    to, n = tokencount.scan(*maps)
    assert to[:, 0].tolist() == [3, 6, 9] and n[:, 0].tolist() == [4, 3, 5]
    assert tokencount.scan(maps[0], np.array([[8, -1], [6, 5], [2, 9]]), maps[2])[0][:, 0].tolist() == [8, -1, -1]
    rng = np.random.default_rng(3)
    a, b, c = (tuple(np.array(x)[None] for x in (rng.permutation(6)[:4], rng.permutation(6)[:4], rng.integers(0, 9, 4))) for _ in range(3))
    left, right = tokencount.compose(tokencount.compose(a, b), c), tokencount.compose(a, tokencount.compose(b, c))
    assert all((x == y).all() for x, y in zip(left, right, strict=True))


def test_long_pieces_in_chunks_of_any_size():
    rng = random.Random(6)
    machine = tokencount.Counter().machine
    lib = Tokenizer.from_file(tokencount.VOCABULARY)
    for piece in ["".join(rng.choice("abcdethinsor") for _ in range(300)), "th" * 200, "x", "internationalisation" * 9]:
        want = len(lib.encode(piece, add_special_tokens=False).ids)
        assert [machine._long(piece.encode(), size) for size in (1, 2, 3, 5, 7, 64, 1024)] == [want] * 7


def test_words_like_the_library():
    enc = wordbpe.Encoder()
    for t in [x for x in ODD if x is not None] + fuzz(300, 9):
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == enc.library.encode(t, add_special_tokens=False).ids


def brute_pieces(texts):
    lib, out = Tokenizer.from_file(wordbpe.VOCABULARY), {}
    for k, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            out[k, p] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    return out


def check_packed(rows):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for start, n in sorted(b):
            assert start == at
            at += n
        assert at <= 2048
    return len(bins)


def test_packing(spark):
    texts = ODD + [" ".join(["word"] * n) for n in (10, 2046, 2047, 2048, 2049, 5000, 1000, 1040, 700, 600)]
    rows = packing.pack_documents(docs(spark, texts)).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == brute_pieces(texts)
    assert check_packed(rows) <= packing.lower_bound(np.array([r["length"] for r in rows])) + 1
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_exchange_saves_bins(spark):
    rng = random.Random(2)
    lengths = [rng.choice([700, 1300, 900, 1024, 1100, 50, 400]) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    whole = packing.best_fit_decreasing(np.array(lengths))[2]
    for per_task in (100_000, 100):
        packed = packing.pack(items, per_task=per_task)
        placed = {r["uid"]: r for r in packed.collect()}
        assert packing.certificate(items, packed) == (len({r["sequence_id"] for r in placed.values()}), packing.lower_bound(np.array(lengths)))
        assert len(placed) == len(lengths)
        rows = [{"sequence_id": r["sequence_id"], "offset": r["offset"], "length": lengths[u]} for u, r in placed.items()]
        assert check_packed(rows) <= (whole if per_task > 3000 else 1.02 * whole + 2)


def test_lower_bound_is_one():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.integers(1, 2049, rng.integers(1, 60))
        assert packing.lower_bound(x) <= packing.best_fit_decreasing(x)[2]
    assert packing.lower_bound(np.array([1025] * 10)) == 10 and packing.lower_bound(np.array([700] * 9)) == 5


def test_language(spark):
    rng = random.Random(1)
    words = {"aa": "the and of with that ing tion".split(), "bb": "der und die nicht ung schen".split()}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for k in range(200) for lang in [("aa", "bb")[k % 2]]]
    train = spark.createDataFrame(rows + [(900, None, "aa"), (901, "the", None)], "doc_id long, text string, lang string")
    model = language.fit(train)
    texts = [None, "", "12 34 $$", "nicht und die", "the tion of", "Ünicht " * 20_000, "x" * 500]
    got = [(r["lang_pred"], r["score"]) for r in language.identify(docs(spark, texts).select("doc_id", "text"), model).orderBy("doc_id").collect()]
    assert [g[0] for g in got[:6]] == ["und", "und", "und", "bb", "aa", "bb"]
    assert all(0 <= s <= 1 for _, s in got) and [s for _, s in got[:3]] == [0, 0, 0]
    kept = language.accept(docs(spark, texts), model, spread=math.inf)  # six learned words say little about "ünicht"
    assert kept.columns == docs(spark, []).columns and {r["doc_id"] for r in kept.collect()} >= {3, 4, 5}
    empty = language.fit(train.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs(spark, texts), empty).collect()} == {"und"}


def plain_total(model, word, k):
    """The summed probability of all segmentations, by the definition."""
    index = {w: i for i, w in enumerate(language.vocabulary(model.path).words)}
    upto = [1.0] + [0.0] * (len(word) + 1)
    word = "▁" + word
    for j in range(1, len(word) + 1):
        upto[j] = sum(upto[i] * model.prob[index[word[i:j]], k] for i in range(max(0, j - 16), j) if word[i:j] in index)
        upto[j] += upto[j - 1] * 1e-9 * (word[j - 1] not in index)
    return math.log(upto[len(word)])


def test_forward_sums_all_segmentations():
    model = language.train({"x": {"hello": 3.0, "ello": 1.0, "international": 2.0}, "y": {"straße": 1.0, "ab" * 100: 2.0}})
    for w in ["hello", "internationalinternational", "ab" * 70, "日本", "a𐐀b", "x"]:
        assert model.log_scores([w])[0] == pytest.approx([plain_total(model, w, k) for k in (0, 1)])
    assert np.isfinite(model.log_scores(["ab" * 10_000])).all()
    assert model.prob[:-1].sum(axis=0) == pytest.approx([1, 1])


def test_posteriors_of_whole_texts(spark):
    model = language.train({"bb": {"und": 3.0, "nicht": 1.0}, "aa": {"the": 2.0, "and": 2.0, "of": 1.0}})
    texts = ["The of, und", "nicht", "THE-and 12 nicht", "a" * 50 + " und the", "x\ny"]
    got = {r["doc_id"]: r for r in language.identify(docs(spark, texts).select("doc_id", "text"), model).collect()}
    for k, t in enumerate(texts):
        total = [sum(plain_total(model, "".join(r), x) for r in __import__("re").findall("[a-z]+", t.lower())) for x in (0, 1)]
        best = int(total[1] > total[0])
        assert got[k]["lang_pred"] == model.langs[best] and got[k]["score"] == pytest.approx(1 / sum(math.exp(t - total[best]) for t in total))


def test_letters_and_clashing_columns(spark):
    model = language.train({"aa": {"the": 2.0, "and": 2.0, "of": 1.0}})
    rows = [(1, "² ½ Ⅷ ١", "a", 1, 0.5), (2, "the of", "b", 2, None), (3, None, None, None, None), (4, "_½_", "", 0, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, `odd.name` int, Score double")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).collect()} == {1: "und", 2: "aa", 3: "und", 4: "und"}
    kept = language.accept(df, model)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [rows[1]]
    assert language.accept(df.limit(0), model).count() == 0


def test_noise_and_other_languages_go(spark):
    rng = random.Random(2)
    parts = {"aa": "the and of with that ing tion er".split(), "zz": "kwa yoj qix zug vup fyk".split()}
    text = lambda x, n: " ".join(rng.choice(parts[x]) + rng.choice(parts[x]) for _ in range(n))
    train = spark.createDataFrame([(k, text("aa", 40), "aa") for k in range(60)], "doc_id long, text string, lang string")
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600))
    df = docs(spark, [text("aa", 5), text("aa", 200), text("zz", 100), noise])
    assert {r["doc_id"] for r in language.accept(df, language.fit(train)).collect()} == {0, 1}


def test_model_scores(spark):
    rng = random.Random(3)
    texts = [None, "", "One one\tONE", "x" * 10_000] + [" ".join(rng.choice(["a b", "c d", "e f g"]) for _ in range(40)) for _ in range(120)]
    df = docs(spark, texts)
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in logbilinear.score(df, F.col("doc_id") % 5 == 1).collect()}
    toks = {k: (t or "").encode().lower().split() + [b"\n"] for k, t in enumerate(texts)}
    c = Counter(w for k, t in toks.items() if k % 5 != 1 for w in t)
    n, v = sum(c.values()), len(c)
    for k, t in toks.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k % 5 == 1, len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
    held = [r for k, r in got.items() if k % 5 == 1 and k > 3]
    assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held) and all(r["score"] <= 0 for r in got.values())


def plain_probability(m, two, one, to):
    """One leaf's probability, by the definition."""
    h, p = m.x[two] * m.x[-2] + m.x[one] * m.x[-1], 1.0
    for k in range(lbltree.LEVELS):
        q, b = m.level(k)
        to, child = divmod(to, lbltree.FAN)
        scores = np.array([h @ q[to, j] + b[to, j] for j in range(lbltree.FAN)], float)
        p *= math.exp(scores[child]) / np.exp(scores).sum()
    return p


def test_tree_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    m = lbltree.Model(rng.integers(0, 50, 1500).astype(float))
    first = rng.integers(0, 1500, 4000)
    second = (first * 7 + 3) % 1500  # the token before tells the next
    trainer, before = lbltree.Trainer(m, rng), m.log_probs(first, first, second).mean()
    for _ in range(60):
        trainer.step(first, first, second)
    assert m.log_probs(first, first, second).mean() > before + 1
    every = np.arange(1500)
    for two, one in ((0, 3), (1499, 700)):
        logs = m.log_probs(np.full(1500, two), np.full(1500, one), every)
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
        assert np.exp(logs[::300]) == pytest.approx([plain_probability(m, two, one, k) for k in range(0, 1500, 300)], rel=1e-3)


@pytest.mark.parametrize("shift", [0, 300, -300])
def test_probabilities_of_any_size(shift):
    """Scores beyond what exponentials hold, and the way without a maximum a token, give the same probabilities."""
    rng = np.random.default_rng(4)
    m = lbltree.Model(rng.integers(1, 50, 1500).astype(float))
    m.x[:] = rng.normal(size=m.x.shape) * 0.3
    two, one, to = rng.integers(0, 1500, (3, 5000))
    want = [math.log(plain_probability(m, two[k], one[k], to[k])) for k in range(0, 5000, 250)]
    m.b[m.b > -1e29] += shift  # alike for all children, so the softmax is the same
    got = m.log_probs(two, one, to)
    assert got[::250] == pytest.approx(want, rel=1e-3, abs=1e-3) and np.isfinite(got).all()


def test_scores_take_no_maximum_a_token(monkeypatch):
    """The usual way: one pass of exponentials a level, whose sums are a product with ones."""
    m = lbltree.Model(np.arange(1.0, 1501))
    ids = np.arange(1500)
    want = m.log_probs(ids, ids, ids)
    monkeypatch.setattr(lbltree, "_ONES", 2 * lbltree._ONES)
    assert m.log_probs(ids, ids, ids) == pytest.approx(want - lbltree.LEVELS * math.log(2), abs=1e-4)


def test_alike_leaves_are_neighbours():
    follows = np.zeros((200, 8))
    follows[::2, 1], follows[1::2, 5] = 50, 50
    order = lbltree.order_leaves(follows)
    assert sorted(order.tolist()) == list(range(200)) and len(set((order[:96] % 2).tolist())) == 1


def test_scores_by_the_definition(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng, seen, real = random.Random(3), {}, logbilinear.train

    def train(coded, leaf, counts, end, workers, **kw):
        seen.update(leaf=leaf, end=end, workers=workers, model=real(coded, leaf, counts, end, workers, **kw))
        return seen["model"]

    monkeypatch.setattr(logbilinear, "train", train)
    monkeypatch.setattr(logbilinear, "PER_WORKER", 900)
    texts = [None, "odd new!", "b"] + [" ".join(rng.choice(["a b", "c d", "e f g", f"rare{rng.randrange(30)}"]) for _ in range(40)) for _ in range(60)]
    got = {r["doc_id"]: r for r in logbilinear.score(docs(spark, texts).repartition(5), F.col("doc_id") % 5 == 1, listed=12).collect()}
    toks = {k: (t or "").encode().lower().split() + [b"\n"] for k, t in enumerate(texts)}
    c = Counter(w for k, t in toks.items() if k % 5 != 1 for w in t)
    top = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:12]]
    kind = lambda w: int(logbilinear._CLASS[w[-1]])
    mass = Counter({k: 0.5 for k in range(32)})
    for w, n in c.items():
        mass[kind(w)] += (n + 0.5) * (w not in top)
    assert seen["workers"] > 2
    for k, t in toks.items():
        if k % 7 and k > 2:
            continue
        leaves = [seen["leaf"][seen["end"]]] * 2 + [seen["leaf"][top.index(w) if w in top else 12 + kind(w)] for w in t]
        want = sum(math.log10(plain_probability(seen["model"], *leaves[i : i + 3])) for i in range(len(t)))
        want += sum(math.log10((c[w] + 0.5) / mass[kind(w)]) for w in t if w not in top)
        assert got[k]["score"] == pytest.approx(want, rel=1e-4)


def test_changes_are_averaged_by_examples():
    rng = np.random.default_rng(1)
    parts = [(rng.normal(size=(5, lbltree.DIM)), rng.normal(size=5), rng.random((2, 5)), np.array([k, 0, 3, 1, 0])) for k in (1, 2, 5)]
    packed = [logbilinear._changes(*p) for p in parts]
    x, b, _, n = logbilinear._read_changes(logbilinear._average(logbilinear._average(packed[0], packed[1]), packed[2]))
    assert n.tolist() == [8, 0, 9, 3, 0]
    assert x[0] == pytest.approx(sum(p[0][0] * p[3][0] for p in parts) / 8, abs=3e-3) and b[2] == pytest.approx(np.mean([p[1][2] for p in parts]), abs=1e-5)


def test_model_without_training(spark):
    from pyspark.sql import functions as F

    assert logbilinear.score(docs(spark, []), F.lit(False)).count() == 0
    got = logbilinear.score(docs(spark, ["a b", None]), F.lit(True)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(0, 0, 0.0)] * 2


TURNS = "conv_id long, turn long, role string, text string, window int, loss string"


def test_chat_round_trip(spark):
    rng = random.Random(5)
    controls = ["</s>", "<s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_again|>", "<|im_end|>", "\\", "\n", "a", "\\\\", "\n<|im_end|>\n", "<<SYS>>"]
    rows = []
    for c in range(20):
        for t in range(rng.randrange(1, 30)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "assistant\n<|im_end|>", "a%0Ab", None])
            text = None if rng.random() < 0.05 else "".join(rng.choice(controls) for _ in range(rng.randrange(0, 12))) + " w" * rng.choice([0, 5, 300])
            rows.append((c, t, role, text, 1, "x"))
    rows += [(99, 0, "assistant", "long " * 50_000, 1, "x"), (99, 0, "assistant", "tie", 1, "x"), (None, None, "assistant", "none", 1, "x"), (None, 3, None, None, 1, "x")]
    df = spark.createDataFrame(rows, TURNS)
    formatted = chat.format_conversations(df, budget=400, history=100)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    groups = {}
    for r in sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[0], r[1])) + (r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        groups.setdefault(r[0], []).append(r)
    assert set(got) == set(groups)
    for c, g in groups.items():
        loss = "".join(r[3] or "" for r in g if r[2] == "assistant")
        assert got[c]["n_turns"] == len(g) and got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in g).encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_windows_hold_the_budget_and_repeat():
    turns = [("system", "be kind")] + [(("user", "assistant")[k % 2], f"turn {k} " + "w " * 40) for k in range(40)]
    made = list(chat.windows(iter(turns), budget=300, history=100))
    assert len(made) > 5 and sum(w.n_new for w in made) == len(turns)
    for k, w in enumerate(made):
        blocks = chat._BLOCK.findall(w.text)
        assert sum(chat.count_tokens(b[2]) for b in blocks) <= 300
        if k:
            assert blocks[0][:2] == ("again", "system") and blocks[1][0] == "again"


def test_long_turns_without_blanks_have_windows_of_their_own():
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghij") for _ in range(9000))
    made = list(chat.windows(iter([("user", text), ("assistant", text)] * 3)))
    assert [w.n_new for w in made] == [1] * 6 and max(len(w.text) for w in made) < 2 * len(text)


def test_escape_is_reversible():
    for t in fuzz(50) + ["</s>", "\\</s>", "\\\\</s>", "\\", "<</SYS>>", "[INST]\\[/INST]"]:
        e = chat.escape(t)
        assert chat.unescape(e) == t
