"""The registered queries against plain brute-force versions on the smallest tables."""

import collections
import hashlib
import itertools
import zlib

import duckdb
import numpy as np
import oracle
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from siltstone.llm import byte_bpe, fingerprints, language, packing, quality, toxicity, url_filter
from siltstone.llm.queries import QUERIES, SQL, URL_RULES
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def run(spark, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, SF).collect()}


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, spark):
    assert oracle.compare(QUERIES[name](spark, SF), oracle.connect(SF), SQL[name]) == []


def test_op1(spark, texts):
    prints = {}
    for key, text in texts.items():
        words = lowered(text).split()
        runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        prints[key] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    group = {k: k for k in prints}
    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            low, high = sorted((group[a], group[b]))
            group = {k: low if g == high else g for k, g in group.items()}
    got = run(spark, "op1_simhash_dedup")
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{prints[k]:016x}", group[k]) for k in prints}


def test_op2(spark, texts):
    ranks = byte_bpe.Ranks.load(RANKS)
    ids = {k: ranks.encoder.encode_ordinary(t) for k, t in texts.items()}
    want = {
        k: (len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[k].encode()).hexdigest()) for k, i in ids.items()
    }
    assert {k: tuple(r)[1:] for k, r in run(spark, "op2_byte_bpe").items()} == want


def test_tree_joins_at_any_place():
    ranks = byte_bpe.Ranks.load(RANKS)
    assert isinstance(ranks.encoder, tiktoken.Encoding)
    alphabet = ["a", "B", "é", "7", " ", "  ", "\n", "\t", "'s", "'", "'re", "r", "e", "!", "…", "中", "\x1c", "\x85", "　", "🙂", "́"]
    draw = np.random.default_rng(3)
    for size in draw.integers(0, 60, 3000):
        text = "".join(draw.choice(alphabet, size))
        ids = byte_bpe.encode(ranks, text, leaf=int(draw.integers(1, 9)))
        assert ids == ranks.encoder.encode_ordinary(text)
        assert byte_bpe.decode(ranks, ids, leaf=3) == text.encode()


def test_op3(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    got = run(spark, "op3_url_filters", "page_id")
    for page in pages:
        rest = page["url"].partition("://")[2]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].partition("#")[0].partition("?")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        row = got[page["page_id"]]
        assert (row.host, row.path, row.rule) == (host, path, max(fits)[1] if fits else None)
        if fits:
            assert row.verdict == max(fits)[2]


def test_link_graph(spark):
    names = ["good.a", "near.b", "spam.c", "buyer.d", "far.e", "lone.f"]
    links = [("good.a", "near.b", 3), ("near.b", "far.e", 1), ("buyer.d", "spam.c", 4), ("buyer.d", "far.e", 1), ("far.e", "near.b", 2)]
    html = {n: "".join(f'<a class=x HREF="//{b}/p">t</a>' * w for a, b, w in links if a == n) + '<a href="/own">o</a>' for n in names}
    pages = spark.createDataFrame([(i, f"https://{n.upper()}/q", html[n]) for i, n in enumerate(names)], "page_id long, url string, html string")
    rules = spark.createDataFrame([("good.a", "/", "allow"), ("spam.c", "/", "block")], "rule_host string, rule_path string, verdict string")
    got = {r.host: r for r in url_filter.filter_urls(pages, rules, shared_paths=False).collect()}

    def ranks(seed, edges):
        out = collections.Counter()
        for a, _, w in edges:
            out[a] += w
        rank = {n: 0.5 * seed.get(n, 0) for n in names}
        for _ in range(100):
            new = {n: 0.5 * seed.get(n, 0) for n in names}
            for a, b, w in edges:
                new[b] += 0.5 * rank[a] * w / out[a]
            rank = new
        return rank

    back = [(b, a, w) for a, b, w in links]
    every = dict.fromkeys(names, 1)
    trust, standing = ranks({"good.a": 1}, links), ranks(every, links)
    distrust, against = ranks({"spam.c": 1}, back), ranks(every, back)
    for n in names:
        assert got[n].trust == pytest.approx(trust[n] / standing[n], abs=1e-6)
        assert got[n].distrust == pytest.approx(distrust[n] / against[n], abs=1e-6)
    assert {n: r.verdict for n, r in got.items()} == {
        "good.a": "allow", "near.b": "allow", "spam.c": "block", "buyer.d": "allow", "far.e": "allow", "lone.f": "allow",
    }
    strict = {r.host: r.verdict for r in url_filter.filter_urls(pages, rules, block_share=0.2, shared_paths=False).collect()}
    assert strict["buyer.d"] == "block" and strict["near.b"] == "allow"


def test_hosts_meet_at_shared_paths(spark):
    paths = {"good.a": ["/x", "/menu"], "twin.b": ["/x", "/x?y", "/menu"], "bad.c": ["/z", "/menu"], "like.d": ["/z#t", "/menu"], "lone.e": ["/own", "//", "/"]}
    rows = [(i, f"https://{h}/q", "".join(f"<a href={p}>t</a>" for p in ps)) for i, (h, ps) in enumerate(paths.items())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("good.a", "/", "allow"), ("bad.c", "/", "block")], "rule_host string, rule_path string, verdict string")
    got = {r.host: r for r in url_filter.filter_urls(pages, rules).collect()}

    counts = collections.Counter((h, p.partition("?")[0].partition("#")[0]) for h, ps in paths.items() for p in ps)
    linking = collections.Counter(p for _, p in counts)
    edges = {(h, p): n / linking[p] for (h, p), n in counts.items() if linking[p] > 1}
    edges.update({(p, h): w for (h, p), w in edges.items()})
    out = collections.Counter()
    for (a, _), w in edges.items():
        out[a] += w

    def ranks(seed):
        rank = collections.Counter()
        for _ in range(100):
            new = collections.Counter({h: 0.5 * s for h, s in seed.items()})
            for (a, b), w in edges.items():
                new[b] += 0.5 * rank[a] * w / out[a]
            rank = new
        return rank

    trust, distrust, standing = ranks({"good.a": 1}), ranks({"bad.c": 1}), ranks(dict.fromkeys(paths, 1))
    for h in paths:
        assert (got[h].trust, got[h].distrust) == (pytest.approx(trust[h] / standing[h], abs=2e-6), pytest.approx(distrust[h] / standing[h], abs=2e-6))
    assert got["twin.b"].trust > got["twin.b"].distrust > 0 and got["like.d"].distrust > got["like.d"].trust > 0
    assert (got["lone.e"].trust, got["lone.e"].distrust) == (0, 0)


def test_neighbours_count_on_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, verdict string")
    alone, met = ({r.id: r for r in url_filter.filter_urls(pages, rules, shared_paths=s).collect()} for s in (False, True))
    assert all(r.verdict == alone[i].verdict for i, r in met.items() if r.rule)
    assert any(abs(r.distrust - alone[i].distrust) > 0.01 for i, r in met.items() if not r.rule)


def base_counts(text):
    words = text.encode().split()
    lines, seen, dup = [line for line in text.split("\n") if line.encode().split()], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_op4(spark, texts):
    got = run(spark, "op4_quality_rules")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    for key, text in texts.items():
        row, want = got[key], base_counts(text)
        assert tuple(row)[1:6] == want
        assert row.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert row.kept == (not row.base_failed and row.rule is None)
    judged = [(labels[k], got[k].kept) for k in labels if not got[k].base_failed]
    assert np.mean([kept for label, kept in judged if label == 1]) > 0.95


def test_decision_list_learns_thresholds(spark):
    draw = np.random.default_rng(4)
    rows = []
    for key in range(3000):
        symbols, dups, words = draw.uniform(0, 0.2), draw.uniform(0, 0.6), draw.uniform(20, 900)
        bad = symbols > 0.12 or (dups > 0.4 and words <= 400)
        rows.append((key, symbols, dups, words, 0 if bad else 1))
    frame = spark.createDataFrame(rows, "id long, symbol_share double, dup_line_share double, n_words double, quality int")
    others = [f for f in quality.FEATURES if f not in frame.columns]
    stats = frame.selectExpr("*", *[f"rand({i}) AS {f}" for i, f in enumerate(others)])
    rules = quality.learn(stats, frame.selectExpr("id AS doc_id", "quality"))
    judged = stats.withColumn("rule", quality.first_rule(rules)).selectExpr("(rule is null) = (quality = 1) AS right").collect()
    assert np.mean([r.right for r in judged]) > 0.95
    assert {c.feature for rule in rules for c in rule} <= set(frame.columns)


def test_op5(spark):
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [(r["toxic"], got[r["doc_id"]].score) for r in labels if got[r["doc_id"]].held_out]
    pos, neg = [s for t, s in held if t], [s for t, s in held if not t]
    area = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert len(pos) > 5 and area > 0.85
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())


def test_toxic_sentences_are_located(spark):
    draw = np.random.default_rng(5)
    plain = [f"w{i}" for i in range(200)]
    plain = ["".join(chr(97 + int(c)) for c in str(1000 + i)) for i in range(200)]
    rows, bad_at = [], {}
    for key in range(600):
        parts = [" ".join(draw.choice(plain, 8)) for _ in range(int(draw.integers(2, 9)))]
        toxic = key % 4 == 0
        if toxic:
            bad_at[key] = int(draw.integers(len(parts)))
            parts[bad_at[key]] += " vileword"
        rows.append((key, ". ".join(parts) + ".", int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.score_documents(frame, toxicity.train(frame)).collect()
    assert np.mean([(r.score >= 0.5) == (r.id in bad_at) for r in scored]) > 0.99
    found = {r.id: r for r in scored if r.id in bad_at}
    assert np.mean(["vileword" in r.worst and len(r.offending) == 1 for r in found.values()]) > 0.97


def test_op6(spark, texts):
    got = run(spark, "op6_sharding")
    shards = collections.defaultdict(list)
    for key, row in got.items():
        raw = texts[key].encode()
        assert (row.size, row.text_crc32, row.law, row.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        shards[row.shard].append(row.slot)
    assert set(shards) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert {len(s) for s in shards.values()} <= {len(texts) // 40, -(-len(texts) // 40)}


def test_big_groups_fill_shards_one_by_one(spark):
    from siltstone.llm import sharding

    rows = [(i, "hot") for i in range(330)] + [(1000 + i, f"pair {i // 2}") for i in range(300)] + [(2000 + i, f"one {i}") for i in range(370)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    text = dict(rows)
    spread = collections.defaultdict(set)
    for r in got:
        spread[text[r.id]].add(r.shard)
    assert collections.Counter(r.shard for r in got) == {s: 100 for s in range(10)}
    assert len(spread["hot"]) <= 5 and np.mean([len(s) == 1 for t, s in spread.items() if t.startswith("pair")]) > 0.97


def test_every_text_twice_stays_together(spark):
    from siltstone.llm import sharding

    rows = [(i, f"text {i % 500}") for i in range(1000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    spread = collections.defaultdict(set)
    for r in got:
        spread[dict(rows)[r.id]].add(r.shard)
    assert collections.Counter(r.shard for r in got) == {s: 100 for s in range(10)}
    assert all(len(s) == 1 for s in spread.values())


def best_fit(lengths, capacity):
    space = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, s in enumerate(space) if s >= length]
        if fits:
            space[min(fits, key=lambda i: space[i])] -= length
        else:
            space.append(capacity - length)
    return len(space)


def test_op7(spark, texts):
    tokenizer = Tokenizer.from_file(WORDS)
    want = set()
    for key, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.add((key, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    rows = QUERIES["op7_best_fit_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    taken = collections.defaultdict(list)
    for r in rows:
        taken[r.sequence_id].append((r.offset, r.length))
    for spans in taken.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(taken) <= best_fit([n for *_, n, _ in want], 4096)


def test_plan_equals_best_fit():
    draw = np.random.default_rng(6)
    for capacity in (10, 50, 4096):
        for _ in range(60):
            lengths = np.minimum(capacity, 1 + draw.exponential(capacity / 6, int(draw.integers(1, 400))).astype(int)).tolist()
            rows, filled = packing.plan(collections.Counter(lengths), capacity), collections.Counter()
            for length, first, last, each, sequence, _ in rows:
                for rank in range(first, last + 1):
                    filled[sequence + (rank - first) // each] += length
            assert sum(filled.values()) == sum(lengths) and max(filled.values()) <= capacity
            assert len(filled) <= best_fit(lengths, capacity)


def test_chunk_tokens_equal_the_tokenizer():
    encode, tokenizer = packing.ChunkTokens(WORDS), Tokenizer.from_file(WORDS)
    draw = np.random.default_rng(7)
    alphabet = ["a", "B", "é", "İ", "Σ", "ß", "7", " ", "\n", "'s", "'re", "r", "!", ".", ",", "中", "\x1c", "\x85", "　", "🙂", "́", "<|endoftext|>", "ﬁ"]
    batch = ["".join(draw.choice(alphabet, size)) for size in draw.integers(0, 50, 3000)]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in encode(batch)]
    assert got == [e.ids for e in tokenizer.encode_batch(batch, add_special_tokens=False)]


def test_op9(spark):
    got = run(spark, "op9_language_spans")
    docs = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert np.mean([got[k].lang_pred == d["lang"] for k, d in docs.items() if got[k].held_out]) > 0.95


def test_mixed_text_is_split_into_spans(spark):
    parts = {"en": "the quick brown fox jumps over the lazy dog and runs away", "de": "der schnelle braune fuchs springt über den faulen hund", "ru": "быстрая лиса прыгает через ленивую собаку и бежит"}
    train = spark.createDataFrame([(t, lang) for lang, t in parts.items()] * 5, "text string, lang string")
    model = language.train(train, switch=6.0)
    text = f"{parts['en']}. {parts['ru']}, {parts['de']}"
    row = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s.lang for s in row.spans] == ["en", "ru", "de"]
    sizes = [len(parts[lang].split()) for lang in ("en", "ru", "de")]
    assert [s.words for s in row.spans] == sizes and [s["first"] for s in row.spans] == [0, sizes[0], sum(sizes[:2])]


def test_paths_are_best():
    model = language.Model(["x", "y", "z"], np.zeros((language.BUCKETS, 3), np.float32), np.ones((1, 3), bool), 2.0)
    draw = np.random.default_rng(8)
    batch = [draw.normal(0, 2, (int(n), 3)) for n in draw.integers(0, 7, 40)]
    for scores, path in zip(batch, model.paths(batch)):
        worth = lambda p: sum(s[l] for s, l in zip(scores, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731, E741
        best = max((worth(p) for p in itertools.product(range(3), repeat=len(scores))), default=0)
        assert worth(path.tolist()) == pytest.approx(best)


def test_op10(spark, texts):
    got = run(spark, "op10_fingerprints")
    order = sorted(texts)
    for key, after in zip(order, [*order[1:], order[0]]):
        text, half = texts[key], len(texts[key]) // 2
        edited = text[: len(text) - half] + texts[after][:half]
        own, changed, following = (fingerprints.fingerprint(t) for t in (text, edited, texts[after]))
        row = got[key]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == (own.hex(), changed.hex())
        assert (row.near_edited, row.near_next) == (fingerprints.likeness(own, changed), fingerprints.likeness(own, following))
    assert np.mean([r.near_edited > r.near_next for r in got.values() if r.n_chars > 100]) > 0.95


def test_block_tables_find_all(spark):
    draw = np.random.default_rng(9)
    base = [bytes(draw.integers(0, 256, 8, np.uint8)) for _ in range(150)]
    for seed in base[:60]:
        value = int.from_bytes(seed)
        for bit in draw.choice(64, int(draw.integers(1, 6)), replace=False).tolist():
            value ^= 1 << bit
        base.append(value.to_bytes(8))
    frame = spark.createDataFrame([(b,) for b in [*base, *base[:5], None]], "fingerprint binary")
    rows = fingerprints.within_radius(frame, frame, radius=3, bits=64, blocks=6).collect()
    distance = lambda a, b: (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    want = {(a, b, distance(a, b)) for a in base for b in base if distance(a, b) <= 3}
    assert {(bytes(r.query), bytes(r.match), r.distance) for r in rows} == want and len(rows) == len(want)


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in rows}
    texts = {k: v for k, v in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()}
    assert 0 < len(kept) < len(texts)
    for key in kept:
        n_words, _, _, _, repeated = base_counts(texts[key])
        assert n_words >= 20 and 100 * repeated <= 30 * n_words
    words = {k: lowered(t).split() for k, t in texts.items()}
    shingles = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}
    near = [(a, b) for a, b in itertools.combinations(sorted(kept), 2) if len(shingles[a] & shingles[b]) >= 0.9 * len(shingles[a] | shingles[b])]
    assert near == []


def test_words_are_letters_with_their_marks():
    import unicodedata

    from siltstone.llm import language

    texts = ["", "́", "1́ b", " ́x", "été la", "हिन्दी भाषा, क्षत्रिय", chr(0x32001) * 3, "a" + chr(0x323AF) + "́̂ 9z"]
    for text in texts:
        words, open_word = [], False
        for char in text:
            kind = unicodedata.category(char)[0]
            if kind == "L":
                if open_word:
                    words[-1] += 1
                else:
                    words.append(1)
                open_word = True
            elif kind == "M" and open_word:
                words[-1] += 1
            else:
                open_word = False
        assert language.split_words(text)[3].tolist() == words, text


def test_rare_letters_are_a_language_too(spark):
    from siltstone.llm import language

    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, chr(0x32001) * 3, None), (4, "̃ 12", None)], "doc_id long, text string, lang string")
    found = {r.id: r.lang_pred for r in language.identify(docs, language.train(docs)).collect()}
    assert found[1] == "en" and found[2] == "fr" and found[3] in ("en", "fr") and found[4] == "und"
