"""Each operator against a brute-force version, an exact round trip or held-out labels."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from unskew.llm import columns, html, langid, license, lm, minhash, packing, pieces, simhash, toxicity
from unskew.llm import queries as Q

P = pytest.importorskip("public_tokenizers")


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def roots(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


# 1


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_matches_brute_force(spark, sf, texts):
    got = {r["doc_id"]: r for r in Q.op1_simhash_groups(spark, sf).collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    assert all(got[i]["fingerprint"] == f"{f:016x}" for i, f in zip(ids, fps, strict=True))
    root = roots(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert [got[i]["component_id"] for i in ids] == [ids[r] for r in root]


def test_bit_sliced_links_in_dense_groups(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = [[sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False)) for _ in base] for _ in range(30)]
    fps = np.unique(np.concatenate([base, *(base ^ np.array(f, np.uint64) for f in flips)]))
    truth = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 4])
    assert roots(len(fps), simhash.forest(fps).tolist()) == truth
    half = len(fps) // 2
    across = simhash.forest(fps, split=half).tolist()
    inner = [(a, b) for lo, hi in ((0, half), (half, len(fps))) for a in range(lo, hi) for b in range(lo, a) if int(fps[a] ^ fps[b]).bit_count() <= 4]
    assert roots(len(fps), inner + across) == truth
    # the same by way of tables, with buckets cut into tiles
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for n in (len(fps), 10**7):
        found = [(place[r["a"]], place[r["b"]]) for r in simhash.links(df, n).collect()]
        assert roots(len(fps), found) == truth


def test_large_bucket_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    one = 0x0123456789ABCDEF
    fps = [one ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)] + [one]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = simhash.links(df, len(fps)).collect()
    assert len(set(roots(len(fps), [(fps.index(r["a"]), fps.index(r["b"])) for r in found]))) == 1


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 105), (200, 200)]
    random.Random(2).shuffle(chain)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got.get(i, 0) == 0 for i in range(61)) and got[105] == got[101] == 100 and 200 not in got


# 2

PAGE = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><header><a href=/>Home</a><h1>Site</h1></header>
<div class="cookie-notice"><p>We use cookies to give you the best experience, please accept them all now.</p></div>
<div id="main-content"><h2>A title of the article</h2><p>First long paragraph, of the article, with a <a href=x>link</a> and enough text to be content, surely. It goes on.</p>
<p>Short.</p><p>Second &eacute; paragraph&nbsp;of the article goes here and it is also quite long, as articles are.</p><aside><p>Related: something else entirely, long enough to look like a paragraph of content.</p></aside></div>
<div class="sidebar"><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div><section id="comments"><p>This is a great article, I really liked to read it, thank you for it.</p></section>
<form><label>Your email</label><input><button>Send</button></form><footer><p>&copy; 2020 Foo. All rights reserved.</p></footer></body></html>"""


def test_html_main_text():
    want = "A title of the article\n\nFirst long paragraph, of the article, with a link and enough text to be content, surely. It goes on.\n\nShort.\n\nSecond é paragraph of the article goes here and it is also quite long, as articles are."
    assert html.main_text(PAGE) == want


WORDS = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."


@pytest.mark.parametrize(("page", "want"), [
    ("<nav><a href=1>Home</a></nav><main><article><header><h1>Title</h1><p class='byline'>By Jane Doe</p></header><p>$</p><h2>Sub</h2><ul><li>First item</li><li><a href=x>Linked item</a></li></ul><pre>x = 1</pre><p>Yes.</p></article></main><aside><p>$</p></aside><section class='comments'><p>$</p></section>", ["Title", "$", "Sub", "First item", "Linked item", "x = 1", "Yes."]),
    ("<div id=top><a href=1>Home</a>|<a href=2>About</a></div><div class='col-main'><h1>Title</h1><div>$</div><div>Short text.</div><div>$</div></div><div class='col-side'><div><a href=1>Link</a></div></div><div id=foot>Contact us | Privacy policy</div>", ["Title", "$", "Short text.", "$"]),
    ("<table><tr><td><a href=1>Home</a></td><td><h2>Title</h2><p>$</p><p>Small.</p><p>$</p></td></tr></table><p><font>Copyright 2001 Foo. All rights reserved.</font></p>", ["Title", "$", "Small.", "$"]),
    ("<form id=page><div class=content><h1>T</h1><p>$</p><p>$ $</p></div><div class=footer><p>$</p></div></form>", ["T", "$", "$ $"]),
    ("<div role='dialog'><p>$</p></div><div role=main><h1>A</h1><p>$</p></div><div class='ad-slot'><p>$</p></div><p hidden>$</p><div style='display: none'>$</div><noscript>$</noscript>", ["A", "$"]),
    ("<section><h1>Title</h1><p>$</p><section><h2>S</h2><p>Short words here</p><p>$</p></section></section><div class='pagination'><a>1</a></div>", ["Title", "$", "S", "Short words here", "$"]),
])
def test_html_of_many_shapes(page, want):
    assert html.main_text(f"<html><body>{page.replace('$', WORDS)}</body></html>").split("\n\n") == [w.replace("$", WORDS) for w in want]


def test_html_of_the_table(spark, sf):
    import html as h
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in Q.op2_html_text(spark, sf).collect():
        inner = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(h.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_minimum_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 8)
        z = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda l: sum(max(0, -v) if k else max(0, v) for v, k in zip(z, l, strict=True)) + sum(c for i, j, c in edges if l[i] != l[j])  # noqa: B023, E731, E741
        assert abs(cost(html.min_cut(z, edges)) - min(map(cost, itertools.product([True, False], repeat=n)))) < 1e-9


# 3


def test_topk_matches_brute_force(spark, sf):
    rows = [(r["vec_id"], [math.floor(256 * float(x)) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in Q.op3_exact_topk(spark, sf).collect())
    want = []
    for q, v in rows:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)


# 4


def test_language_of_held_out_documents(spark, sf, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = Q.op4_language_id(spark, sf).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_ngrams_by_hand():
    codes, counts = langid.ngrams("ab, AB 1")
    a, b, blank = ord("a"), ord("b"), 32
    want = {a: 2, b: 2, blank << 21 | a: 2, a << 21 | b: 2, b << 21 | blank: 2, blank << 42 | a << 21 | b: 2, a << 42 | b << 21 | blank: 2}
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == want


def test_texts_without_letters_are_undetermined():
    model = langid.Model({"en": langid.ngrams("the cat")[0], "zz": np.array([0x10400 + 40], np.int64)})
    assert [model.predict(t) for t in (None, "", "12 ² ½ 🙂 !", "_")] == [("und", 0.0)] * 4
    assert model.predict("the 🙂 cat")[0] == "en" and model.predict("\U00010400")[0] == "zz"
    long = "word " * 300_000
    whole, count = langid.ngrams(long)
    assert dict(zip(whole.tolist(), count.tolist(), strict=True))[ord("w")] == 300_000


# 5


def test_packing_is_whole_and_unpadded(spark, sf, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got, pieces_ = Q.op5_packing(spark, sf).collect(), {}
    for r in got:
        pieces_.setdefault(r["doc_id"], []).append(r)
    for i, t in texts.items():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces_[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    rows = {}
    for r in got:
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in rows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0 and at < 4096


def test_words_match_the_tokenizer():
    w = packing.Words(P.path("word_bpe_49k.json"))
    odd = ["Hello wörld\x1dfoo", "", "  it's <|endoftext|> a\ttest'll é x", "İstanbul ΣΑΣ 12ab３ don't", "a b\x85c ́d ǅ ŉ ſ ﬁ x\0y I'LL --$%", "naïve Ünïcode ßtraße 3.14 e-mail@x.org"]
    for t, ids in zip(odd, w.ids(odd), strict=True):
        assert ids.tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids


def test_balance_fills_by_cost():
    placed, rest = packing.balance([3000, 2000, 2000, 1192], [4096, 4096])
    assert not rest and sum(n for _, _, n, _ in placed) == 8192 and [s for i, _, _, s in placed if i == 0] == [0]


# 6


def test_toxicity_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in Q.op6_toxicity(spark, "/root/testdata/sf0.1").collect()}
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in known if fold(r["doc_id"], 4) == 2]
    hits = sum(a and b for a, b in held)
    assert hits >= 0.9 * sum(a for a, _ in held) and hits >= 0.9 * sum(b for _, b in held)
    assert all(r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (fold(i, 4) == 2) for i, r in got.items())


def test_folding_and_exceptions():
    assert toxicity.folded("You 1D1OT, lо​ser! i$d") == " you idiot ioser isd "
    lexicon = toxicity.Lexicon({toxicity.fold_entry("idiot"): 3.0, toxicity.fold_entry("clow*"): 2.0}, {toxicity.fold_entry("idiot proof")})
    assert [w for _, w in lexicon.hits(toxicity.folded("an IDIOT, not idiot-proof; clowns idiots"))] == [3.0, 2.0]
    assert lexicon.score("idiot") > lexicon.score("idiot " + "word " * 200) > lexicon.score("word")


# 7


def test_minhash_against_exact_likeness(spark, sf, texts):
    got = {r["doc_id"]: r for r in Q.op7_minhash(spark, sf).collect()}
    ids = sorted(texts, reverse=True)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a or b else 1.0

    errors = []
    for k, i in enumerate(ids):
        t, following = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        errors += [got[i]["near_edited"] - jaccard(shingles(t), shingles(edited)), got[i]["near_next"] - jaccard(shingles(t), shingles(following))]
    assert np.abs(errors).mean() < 0.03 and np.abs(errors).max() < 0.15 and abs(np.mean(errors)) < 0.01
    first = {}
    for i, t in texts.items():
        assert first.setdefault(t or "", got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_minhash_plan_is_native(spark, sf):
    plan = Q.op7_minhash(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# 8


@pytest.mark.parametrize("size", [lm.Size(), lm.Size(64, 400, 20_000, 5_000), lm.Size(4, 50, 3_000, 500)])
def test_lm_matches_brute_force(spark, docs, texts, monkeypatch, size):
    weights = np.tile([0.5, 0.3, 0.2], (lm.BUCKETS, 1))
    weights[0], weights[3] = [0, 0.6, 0.4], [0.2, 0.5, 0.3]
    monkeypatch.setattr(lm, "mixture", lambda *a: weights)
    got = {r["doc_id"]: r for r in lm.score(docs, size=size).collect()}
    words = {i: (t or "").encode().lower().split() + [b""] for i, t in texts.items()}
    train = [w for i, w in words.items() if fold(i, 10)]
    one, two = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip([b"", *ws], ws, strict=False))
    n, v = sum(one.values()), len(one)
    for i, ws in words.items():
        score = base = 0.0
        for h, w in zip([b"", *ws], ws, strict=False):
            a, b, z = weights[min(one[h].bit_length(), lm.BUCKETS - 1)]
            score += math.log10(a * two[h, w] / max(1, one[h]) + b * one[w] / n + z / (v + 1))
            base += math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1)))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(one[w] > 0 for w in ws), n, fold(i, 10) == 0)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-6)


def test_lm_beats_its_base_on_held_out_documents(spark, sf):
    held = [r for r in Q.op8_lm_score(spark, sf).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_mixture_finds_the_weights():
    code = lambda b, f2, f1: b << 16 | int(lm._code(np.array([f2]))[0]) << 8 | int(lm._code(np.array([f1]))[0])
    w = lm.mixture(np.array([code(4, 0.5, 1e-4), code(4, 0, 1e-4)]), np.array([80.0, 20.0]), 1000)
    assert abs(w.sum(1) - 1).max() < 1e-9 and 0.7 < w[4][0] < 0.85 and w[0][0] == 0


def test_columns_round_trip():
    rng = np.random.default_rng(0)
    made = dict(a=rng.integers(0, 300, 50), b=np.sort(rng.integers(0, 1 << 40, 50)), c=rng.integers(0, 1 << 64, 9, dtype=np.uint64), d=rng.random(5), e=np.empty(0, np.int64), f=np.array([-3, 4]), g=np.sort(rng.integers(0, 1 << 64, 9, dtype=np.uint64)), h=np.array([True, False]))
    back = columns.unpacked(columns.packed(**made))
    assert all((back[k] == v).all() and len(back[k]) == len(v) for k, v in made.items())


# 9


def test_licences_of_the_table(spark, sf, texts):
    families = {"Apache": "Licensed under the Apache License", "MIT": "Released under the MIT License", "GPL": "licensed under the GNU General Public License, version", "CC-BY-NC": "Licensed under CC BY-NC"}
    got = {r["doc_id"]: r["licenses"] for r in Q.op9_license_scan(spark, sf).collect()}
    assert all(got[i] == sorted(f for f, p in families.items() if p in (t or "")) for i, t in texts.items())


def test_licence_families_and_others(docs):
    model = license.fit(docs)
    for family, templates in license.TEMPLATES.items():
        for t in templates:
            assert family in [f for f, *_ in model.scan([f"Copyright 2024 Somebody Else. {t}"])[0]], (family, t)
    assert model.scan(["My driver's license is valid.", "We met at the public library to talk about software."]) == [[], []]


# 10


def test_pieces_match_brute_force(texts):
    codec = pieces.Codec(P.path("piece_bpe_32k.model"))
    value = {codec.text[i]: codec.score[i] for i in codec.ids}

    def best(text):
        b = text.encode()
        at = [0.0] + [-math.inf] * len(b)
        for i in range(len(b)):
            if at[i] > -math.inf:
                for j in range(i + 1, min(len(b), i + codec.longest) + 1):
                    if b[i:j] in value:
                        at[j] = max(at[j], at[i] + value[b[i:j]])
                size = int(codec.width[b[i]])
                at[i + size] = max(at[i + size], at[i] + size * codec.penalty)
        return at[-1]

    odd = ["hello world", "  two  spaces\n\tx", "日本語 テスト 🙂🙂 é́", "a" * 700 + " b", *[(t or "")[:200] for t in list(texts.values())[:40]]]
    for t, (ids, score) in zip(odd, codec.encode(odd), strict=True):
        assert codec.decode(ids.tolist()) == t
        assert math.isclose(score, best(pieces.MARK + t.replace(" ", pieces.MARK)) if t else 0, rel_tol=1e-12)
        assert math.isclose(score, sum(codec.score[i] if not codec.byte[codec.byte == i].size else codec.penalty for i in ids.tolist()), rel_tol=1e-12)


def test_pieces_round_trip(spark, docs, texts):
    path = P.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs, path), path).collect()}
    assert got == {i: t or "" for i, t in texts.items()}


def test_double_array_holds_just_its_keys():
    rng = random.Random(5)
    keys = sorted({bytes(rng.randrange(256) for _ in range(rng.randint(1, 5))) for _ in range(600)})
    trie = pieces.DoubleArray(keys)
    assert [trie.get(k) for k in keys] == list(range(len(keys)))
    others = {bytes(rng.randrange(256) for _ in range(rng.randint(1, 5))) for _ in range(2000)} - set(keys)
    assert all(trie.get(k) == -1 for k in others)


# pipeline


def test_every_operator_has_its_query():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
