import base64
import bz2
import gzip
import hashlib
import lzma
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import quote

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from skein.llm import common, line_quality, mixing, packing, secret_scan, suffix_tree_lm, token_counts

from .conftest import read
from .test_dedup import WORDS, texts_of

# Quality rules


def brute_features(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_base_features(spark, edge, empty):
    for df in (read(spark), edge):
        got = line_quality.quality(df)
        rows = [(r["text"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]), r["kept"]) for r in got.collect()]
        assert len(rows) == df.count()
        for text, found, kept in rows:
            assert found == brute_features(text) and not (kept and found[-1])
    assert line_quality.quality(empty).count() == 0


def test_depleted_documents_go_and_copies_stay(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common = " ".join(word() for _ in range(40))
    rows = [(k, "\n".join([common, *(" ".join(word() for _ in range(8)) for _ in range(3))]), "h") for k in range(30)]
    rows += [(100 + k, rows[0][1].replace(common, "") + "\n" + " ".join(word() for _ in range(30)), "h") for k in range(30)]
    text = "\n".join(" ".join(word() for _ in range(20)) for _ in range(4))
    rows += [(200 + k, text, "h") for k in range(40)] + [(300 + k, text + f"\nlast {k}", "h") for k in range(40)] + [(400, common + "\n" + text, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["kept"], r["removed_words"]) for r in line_quality.quality(df, many_documents=10, many_share=0.0).collect()}
    assert all(got[k] == (False, 40) for k in range(30))  # over half of each is a line that many have
    assert all(got[200 + k] == (True, 0) and got[300 + k][0] for k in range(40))  # exact and near copies are one document
    assert got[400] == (True, 0)


def test_documents_that_share_a_block_are_counted_each(spark):
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = []
    for h, (shared, own) in enumerate([(1, 1), (3, 2), (12, 2), (40, 3)]):
        block = [line(10) for _ in range(shared)]
        rows += [(1000 * h + k, "\n".join(block + [line(6) for _ in range(own)]), f"h{h}") for k in range(60)]
        rows += [(1000 * h + 500 + k, "\n".join([line(10)] * 2), f"h{h}") for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["removed_words"] for r in line_quality.quality(df, many_documents=59, many_share=0.0).collect()}
    for h, shared in enumerate([1, 3, 12, 40]):
        assert {got[1000 * h + k] for k in range(60)} == {10 * shared}
    assert {r["removed_words"] for r in line_quality.quality(df, many_documents=60, many_share=0.0).collect()} == {0}


def brute_quality(rows, many_documents):
    """kept, removed words and kept text of (host, text) rows, none of which are near copies."""
    form = lambda x: " ".join(WORDS.findall(x)).lower()
    seen = defaultdict(set)
    for host, text in rows:
        for line in (text or "").split("\n"):
            if form(line):
                seen[host, form(line)].add(text)
    out = []
    for host, text in rows:
        lines = (text or "").split("\n")
        gone = [bool(form(x)) and len(seen[host, form(x)]) > many_documents for x in lines]
        removed, n = sum(len(form(x).split()) for x, g in zip(lines, gone) if g), len(WORDS.findall(text or ""))
        depleted = 2 * removed > n and (n - removed < 50 or 5 * removed > 4 * n)
        left = text if not any(gone) else "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((not brute_features(text)[-1] and not depleted, removed, left))
    return out


def test_quality_is_a_plain_count_of_lines(spark):
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choice("abcdefgH") for _ in range(5)) for _ in range(n))
    block = {h: [line(rng.randint(1, 12)) for _ in range(25)] for h in ("a", "b", None)}
    rows = []
    for _ in range(400):
        host = rng.choice(["a", "b", None])
        shared = [rng.choice([str.upper, str, lambda x: f" {x}\t"])(x) for x in rng.sample(block[host], rng.randint(0, 25))]
        own = [line(rng.randint(1, 40)) for _ in range(rng.randint(2, 5))] + [line(60)] * rng.randint(0, 1)
        mixed = shared + own + [""] * rng.randint(0, 2)
        rng.shuffle(mixed)
        rows.append((host, "\n".join(mixed)))
    rows += [("one", line(60)) for _ in range(30)] + [("one", None), ("a", "")]
    df = spark.createDataFrame([(k, t, h) for k, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["kept"], r["removed_words"], r["kept_text"]) for r in line_quality.quality(df, many_documents=40, many_share=0.0).collect()}
    want = brute_quality(rows, 40)
    assert [got[k] for k in range(len(rows))] == want
    assert 20 < sum(w[0] for w in want) < 400 and any(w[0] and w[1] for w in want)


# Mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, left, live = {}, share * sum(sizes.values()), list(names)
    while live:
        total = sum(weight[s] for s in live)
        over = [s for s in live if left * weight[s] / total >= most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in live}
            break
        for s in over:
            out[s] = most * sizes[s]
            live.remove(s)
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in names if s not in live)
    return out


def test_targets_and_copies(spark, edge, empty):
    rng = random.Random(5)
    tables = [read(spark), edge.withColumn("rate", F.lit(1)).withColumn("copy", F.lit("x"))]
    for n in (1, 4, 9):
        rows = [(k, "w " * rng.randint(0, 200), rng.choice([None, *(f"s{j}" for j in range(n))])) for k in range(300)]
        tables.append(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for df in tables:
        got = mixing.mix(df).cache()
        sizes = defaultdict(int)
        for r in df.collect():
            sizes[r["source"]] += len(WORDS.findall(r["text"] or ""))
        exp, taken = brute_targets(sizes), Counter()
        for r in got.collect():
            assert r["size"] == len(WORDS.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(exp[r["source"]], rel=1e-9) and 0 <= r["copies"] <= 2
            taken[r["source"]] += r["copies"] * r["size"]
        for s, n in sizes.items():
            spread = math.sqrt(sum(len(WORDS.findall(r["text"] or "")) ** 2 for r in df.collect() if r["source"] == s)) * 0.5
            assert abs(taken[s] - exp[s]) <= 5 * spread + 1
        assert mixing.emit(got).count() == got.agg(F.sum("copies")).first()[0]
        again = mixing.mix(df.repartition(3))
        assert sorted(map(str, again.select("doc_id", "copies").collect())) == sorted(map(str, got.select("doc_id", "copies").collect()))
    assert mixing.mix(empty).count() == 0


# Packing


def test_packing(spark, edge, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for df, longest in ((read(spark), 4096), (edge, 4096), (edge, 8)):
        exp = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in texts_of(df))
        rows = sorted(packing.pack(df, longest=longest).collect(), key=lambda r: (str(r["doc_id"]), r["sequence_id"]))
        assert len({r["sequence_id"] for r in rows}) == len(rows)
        got, ids = Counter(), []
        for r in rows:
            part = np.frombuffer(r["ids"], "<u4")
            assert len(part) == r["length"] == 1 << r["bucket"] <= longest and r["offset"] == 0 and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["start"] == len(ids)
            ids += part.tolist()
            if len(ids) == r["doc_tokens"]:
                got[r["doc_id"], tuple(ids)] += 1
                ids = []
        assert got == exp and not ids
    assert packing.pack(empty).count() == 0


def test_words_are_encoded_as_in_their_texts():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(packing.default_tokenizer()), packing.word_encoder(packing.default_tokenizer())
    texts = ["Ünïcode ΣΑΣ. İstanbul, H̱x ẖ ½ 3.5kg don't we'll a|b | || <|endoftext|> x<|startoftext|>y em\x1cfs\x85nel ﬁne, 中文字。 ñ!! ... Hi?!,", " \n\t ", "|", "-_- 'S it'S I'M ǅ ŉ ß. ẞ, ª º² word.word foo;bar:"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.binary_lengths(2 * 4096 + 5) == [4096, 4096, 4, 1]


def test_packing_remembers_bounded_bytes(monkeypatch):
    """Words that don't come again don't add up in a worker, and words that do stay; ids are the same all the same."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "ONCE", 30_000, raising=False)
    monkeypatch.setattr(packing, "AGAIN", 20_000, raising=False)
    path = packing.default_tokenizer()
    common.remembered("packing").clear()
    try:
        tokenizer, encode = Tokenizer.from_file(path), packing.word_encoder(path)
        stores = [x for x in common.remembered("packing")[path] if isinstance(x, dict)]
        for k in range(40):
            texts = [f"The same words, again. {'y' * 40_000 if k == 7 else ''} " + " ".join(f"w{k}x{i}{'q' * 100}, {'ab'[i % 2] * (k + 9)};" for i in range(40)), "", "words? again"]
            assert [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            assert sum(len(word) + len(ids) for store in stores for word, ids in store.items()) <= 50_000
        assert b"again" in stores[-1] and b"words," in stores[-1]
        assert all(store.bytes == store.size(store) <= store.most for store in stores)
    finally:
        common.remembered("packing").clear()


def test_special_strings_are_special_in_their_own_case_only():
    """A-Z were lowered before the tokenizer looked for its special strings."""
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(packing.default_tokenizer()), packing.word_encoder(packing.default_tokenizer())
    texts = ["<|ENDOFTEXT|>", "Words, <|EndOfText|> more.<|endoftext|>&&&", "a<|STARTOFTEXT|> <|startoftext|>", "The <|end of text|>. Ends<| |>, OFTEXT|>!", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_latin_words_skip_the_tokenizers_expressions():
    """F1 of FINDINGS_r03.md as it is at f7829d3: each new word went through regular expressions that words of letters don't need."""
    from tokenizers import Tokenizer

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.characters = tokenizer, 0

        def encode_batch_fast(self, texts, **options):
            self.characters += sum(map(len, texts))
            return self.tokenizer.encode_batch_fast(texts, **options)

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

    path = packing.default_tokenizer()
    common.remembered("packing").clear()
    try:
        packing.word_encoder(path)
        workers, tokenizer = common.remembered("packing"), Tokenizer.from_file(path)
        workers[path] = (counted := Counted(tokenizer), *workers[path][1:])
        encode = packing.word_encoder(path)
        names = ["".join("abcdefghij"[int(x)] for x in str(k * 7919)) for k in range(2_000)]
        texts = [" ".join(f"{w}&&& {w.title()}é, x{w}. ({w}Éİ" if k % 100 == 0 else f"{w}$$$ Ü{w} {w.title()};" for k, w in enumerate(names)), " 3.5 Слово, 文字 don't \n"]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert 0 < counted.characters < 1_000  # 64,017 before
    finally:
        common.remembered("packing").clear()


def test_tokenizers_of_other_rules_encode_latin_words_in_full(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    monkeypatch.setattr(packing, "RULES", {"normalizer": None})
    common.remembered("packing").clear()
    try:
        encode, text = packing.word_encoder(path), "Words, wörds: WÖRDS&&& and 3 more."
        assert common.remembered("packing")[path][1] is None
        assert np.frombuffer(encode([text.encode()])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    finally:
        common.remembered("packing").clear()


def test_texts_are_encoded_together_by_bytes():
    assert list(packing.together([])) == [] and list(packing.together([0, 0])) == [slice(0, 2)]
    assert list(packing.together([3, 9, 0, 2, 8, 20, 1], 10)) == [slice(0, 1), slice(1, 3), slice(3, 5), slice(5, 6), slice(6, 7)]
    encode = packing.word_encoder(packing.default_tokenizer())
    assert encode([]) == [] and encode([b"", b" \n"]) == [b"", b""]


# Secret scans

KEY = "AKIA" + "QWERTYUIOP123456"


def brute_matches(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


def test_base_spans():
    rng = random.Random(3)
    parts = ["password", "Secret=", "token: ", "api_key", "APIKEY='", "=", ":", '"', "abc", "abcdef12", "AKIA", "QWERTYUIOP123456", "0123456789abcdef", "ſecret", "é", " ", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert secret_scan.matches(text) == brute_matches(text)


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress, lambda b: gzip.compress(zlib.compress(b)), lambda b: b])
def test_nested_layers(pack):
    inner = base64.b64encode(pack(f"here is {KEY} and password = hunter2xyz".encode())).decode()
    for wrap in (lambda s: s, lambda s: base64.b64encode(s.encode()).decode(), lambda s: "".join(f"%{b:02x}" for b in s.encode()), lambda s: "".join(f"\\u{ord(c):04x}" for c in s)):
        coded = wrap(inner)
        text = f"é {coded} end"
        base, spans, layers, cut = secret_scan.scan(text)
        assert base == brute_matches(text) and not cut and layers >= 1
        assert ("access", 2, 2 + len(coded)) in spans or any(k == "access" and 2 <= a < b <= 2 + len(coded) for k, a, b in spans)
        assert set(base) <= set(spans)


def test_places_in_escaped_text_and_cycles():
    assert secret_scan.scan("x \\u0041KIA" + KEY[4:] + " y")[1] == [("access", 2, 2 + len(KEY) + 5)]
    assert secret_scan.scan("%70assword%3Dhunter22 z")[1] == [("assign", 0, 21)]
    assert secret_scan.scan("%25" * 2000)[2] < 10
    assert secret_scan.scan("%2525252541")[2] == 5  # each layer is one decoding further
    bomb = base64.b64encode(gzip.compress(b"a" * (1 << 20))).decode()
    assert secret_scan.scan(bomb, most_decoded=1000)[3]


def test_wrapped_base64_and_bytes_in_urls():
    found = lambda text: {s for s in secret_scan.scan(text)[1] if s[0] == "access"}
    plain = ("é" * 24 + "x " + KEY + " " + "lorem ipsum " * 20).encode()  # the key lies over the boundary at 57 bytes
    packs = [gzip.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress, lambda b: b]
    for pack in packs:
        for wrapped in (base64.encodebytes(pack(plain)).decode(), base64.encodebytes(pack(plain)).decode().replace("\n", "\r\n  ")):
            run = wrapped.rstrip()
            for before, after in (("x: ", " end"), ("-----BEGIN CERTIFICATE-----\n", "\n-----END"), ("first\n", "\nlast words")):
                assert ("access", len(before), len(before) + len(run)) in found(before + run + after)
    for pack in packs[:-1]:
        run = quote(pack(plain))
        assert ("access", 2, 2 + len(run)) in found(f"a={run} b")
        run = "".join(f"%{b:02X}" for b in pack(plain))
        assert ("access", 2, 2 + len(run)) in found(f"a={run} b")
    coded = "".join(f"%{b:02x}" for b in KEY.encode())
    assert found(f"%E9%20{coded}%FF") == {("access", 3, 6 + len(coded))}  # a run is one place


def test_no_layer_is_cut(monkeypatch):
    hidden = base64.b64encode(KEY.encode()).decode()
    spans = lambda text: secret_scan.scan(text)[1:]
    found, _, cut = spans("%41 \\u0041 " + "lorem, ipsum " * 1_400_000 + hidden)  # 18 Mi characters and two escapes
    assert not cut and [s[0] for s in found] == ["access"]
    monkeypatch.setattr(secret_scan, "WINDOW", 5000)
    monkeypatch.setattr(secret_scan, "PIECE", 1000)
    text = "word, " * 3000 + f"secret = {'x' * 2500}y %41{KEY[1:]}, {hidden}, " + "word, " * 3000
    whole = text.index(hidden)
    at = text.index("%41")
    assert {("access", whole, whole + len(hidden)), ("access", at, at + len(KEY) + 2)} <= set(spans(text)[0])
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
        packed = base64.b64encode(pack(b"word, " * 3000) + pack(text.encode())).decode()  # two members
        assert [s for s in spans(packed)[0] if s[0] == "access"] == [("access", 0, len(packed))]


def test_scan_of_tables(spark, edge, empty):
    for df in (read(spark), edge):
        got = secret_scan.secret_spans(df).collect()
        exp = Counter((i, tuple(brute_matches(t or ""))) for i, t in texts_of(df))
        assert Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["base"])) for r in got) == exp
    assert secret_scan.secret_spans(empty).count() == 0


def test_base64_behind_a_path_in_lines_and_in_utf16():
    secret = "the password = hunter2hunter2 is in here, and more text that is long enough to be wrapped over several lines"
    plain = base64.b64encode(secret.encode()).decode()
    packed = base64.encodebytes(gzip.compress(secret.encode() * 3)).decode()
    two = gzip.compress(b"nothing to see") + gzip.compress(secret.encode())
    for text in (f"see data/{plain} there", f"a/bc/{plain}", f"x/{base64.b64encode(gzip.compress(secret.encode())).decode()}",
                 f"begin\n{packed}\nend", f"begin\n{base64.encodebytes(secret.encode()).decode()}", f"-enc {base64.b64encode(secret.encode('utf-16-le')).decode()}",
                 base64.b64encode(two).decode()):
        base, spans, _, _ = secret_scan.scan(text)
        assert not base and any(k == "assign" for k, _, _ in spans), text
        assert all(0 <= a < b <= len(text) for _, a, b in spans)
    for text in ("/usr/local/lib/python/site/packages/numpy/core", "averyveryverylongwordthatgoeson" * 3, "WXYZ" * 20):
        assert not secret_scan.scan(text)[1]


# Language-model scoring


def test_scores(spark, edge, empty):
    docs = read(spark, size="sf0.01")
    few = {r["doc_id"]: r for r in suffix_tree_lm.score(docs, hot_share=2.0).collect()}  # nothing is broadcast
    rows = {r["doc_id"]: r for r in suffix_tree_lm.score(docs).collect()}
    tokens = {i: t.encode().lower().split() + [None] for i, t in texts_of(docs)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total = sum(count.values())
    for i, t, r in [(i, t, some[i]) for some in (few, rows) for i, t in tokens.items()]:
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(w in count for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in t), rel=1e-9)
    apart = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart) * 0.95  # a clear gain on texts that it hasn't seen
    assert sum(r["score"] > r["base_score"] for r in apart) > 0.8 * len(apart)
    assert len(suffix_tree_lm.score(edge).collect()) == edge.count()
    assert suffix_tree_lm.score(empty).count() == 0
    assert all(r["train_tokens"] == 0 for r in suffix_tree_lm.score(edge, training=F.lit(False)).collect())


def brute_tree(texts, known):
    """log10 probabilities by a suffix tree kept in dictionaries: known texts teach it, all are scored."""
    tokens = [t.encode().lower().split() + [None] for t in texts]
    taught = [w for w, k in zip(tokens, known) if k]
    one = Counter(x for w in taught for x in w)
    total = sum(one.values())
    low = {(w,): (n + 1) / (total + len(one) + 1) for w, n in one.items() if n > 1}
    seen, contexts, own, length = {(w,): n for w, n in one.items() if n > 1}, {(): None}, {}, 1
    while True:
        counts = Counter(tuple(w[k : k + length + 1]) for w in taught for k in range(len(w) - length))
        strings = {g: n for g, n in counts.items() if n > 1 and g[:-1] in seen and g[1:] in seen and g[1:-1] in contexts}
        by = defaultdict(list)
        for g in strings:
            by[g[:-1]].append(g)
        grown = {}
        for c, followers in by.items():
            share = {g: (strings[g] - 0.75) / seen[c] for g in followers}
            weight = 1 - sum(share.values())
            gain = sum(strings[g] * math.log((share[g] + weight * low[g[1:]]) / low[g[1:]]) for g in followers)
            gain += (seen[c] - sum(strings[g] for g in followers)) * math.log(weight)
            if gain > 0.5 * math.log(total) * (len(followers) + 1):
                grown[c] = weight
                own |= {g: share[g] + weight * low[g[1:]] for g in followers}
        if not grown:
            break
        low |= {g: own.get(g, low[g[1:]]) for g in strings}
        contexts |= grown
        seen |= strings
        length += 1

    def p(context, w):
        while context not in contexts:
            context = context[1:]
        if not context:
            return (one[w] + 1) / (total + len(one) + 1)
        return own.get((*context, w)) or contexts[context] * p(context[1:], w)

    scores = [sum(math.log10(p(tuple(w[max(0, k - length) : k]), w[k])) for k in range(len(w))) for w in tokens]
    return scores, contexts, lambda c: sum(p(c, w) for w in one) + p(c, object())


def test_scores_are_those_of_a_plain_tree(spark):
    rng = random.Random(5)
    phrases = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(2, 9))] for _ in range(40)]
    texts = [" ".join(x for _ in range(rng.randint(0, 25)) for x in rng.choice(phrases) + [f"w{rng.randrange(400)}"]) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    want, contexts, whole = brute_tree(texts, [not h for h in held])
    assert max(map(len, contexts)) >= 3  # contexts of several lengths
    for c in list(contexts)[:50]:
        assert whole(c) == pytest.approx(1.0)
    for hot in (suffix_tree_lm.HOT_SHARE, 1e-3, 2.0):  # all strings broadcast, some, none
        got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(docs, hot_share=hot).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-9)


def test_hashes_are_those_of_sql(spark):
    one, two = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, (2, 500))
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(one, two)], "a long, b long").select(F.xxhash64("a", "b")).collect()
    assert [r[0] for r in rows] == suffix_tree_lm.hashed_pair(one, two).tolist()


# Token counts


def test_segment_trees_against_encoding_again():
    count = token_counts.counter(token_counts.default_tokenizer())
    rng, letters = random.Random(3), "ab é1' .\n\tsretvlmd,日²ñZ"
    for trial in range(600):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 200, 1500])))
        tree = token_counts.SegmentTree(text, count)
        for _ in range(rng.randint(1, 5)):
            at, gone, new = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 2, 10, 500]), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 8, 400])))
            tree.edit(at, gone, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + gone :]
            assert tree.text() == text and tree.pieces() == count.pattern.findall(text)
            assert tree.n_tokens == len(count.tokenizer.encode(text, add_special_tokens=False).ids) and tree.n_chars == len(text)
        assert tree.count_before(len(text)) == tree.n_tokens and tree.count_before(0) == 0


def test_few_characters_are_encoded_again():
    count = token_counts.counter(token_counts.default_tokenizer())
    tree = token_counts.SegmentTree("some words in a long text. " * 4000, count)
    assert tree.edit(50_000, 3, "new") < 60


def test_edited_counts(spark, edge, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_counts.default_tokenizer())
    for df in (read(spark), edge):
        got = token_counts.edited_counts(df, token_counts.sample_edits()).collect()
        assert len(got) == df.count()
        for r in got:
            assert r["n_tokens_edited"] == len(tokenizer.encode(r["edited_text"], add_special_tokens=False).ids)
            assert r["edited_sha256"] == hashlib.sha256(r["edited_text"].encode()).hexdigest()
        before = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in texts_of(df))
        assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == before
    assert token_counts.edited_counts(empty, F.lit(None)).count() == 0


def test_symbols_and_lengths_counted_at_once(spark):
    """words are hashed in arrays, and several lengths are counted in one reading of the texts."""
    import pyarrow as pa

    texts = [b"", b"A b\x0bC\x1cd \x00 a", b" x" * 9 + b"\xc3\x89", b"z" * 64 + b" " + b"Z" * 65 + b" z" * 3, b"abcdefgh ABCDEFGHi abcdefgh", b"\n"]
    found, owner, place = suffix_tree_lm.symbols(pa.array(texts, pa.binary()))
    words = [t.lower().split() + [None] for t in texts]
    assert owner.tolist() == [k for k, w in enumerate(words) for _ in w] and place.tolist() == [k for w in words for k in range(len(w))]
    pairs = set(zip([x for w in words for x in w], found.tolist(), strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    rows = spark.createDataFrame([(True, bytearray(t)) for t in texts * 2], "training boolean, text binary")
    counted = {(r["len"], r["n"]): r["many"] for r in suffix_tree_lm.string_counts(rows, 2, None, None, more=2).groupBy("len", "n").count().withColumnRenamed("count", "many").collect()}
    exp = Counter((size, n) for size in (2, 3, 4) for n in Counter(tuple(w[k : k + size]) for w in words * 2 for k in range(len(w) - size + 1)).values())
    assert counted == exp


def test_suffix_tree_strings_meet_in_packed_buckets():
    """What texts ask for goes to the join as bytes of many strings, not as a row each; sums are those of a plain look-up."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, 500)
    weights = [np.ones(500), rng.random(500), rng.random(500)]
    row = np.sort(rng.integers(0, 40, 3000) * 7 + (5 << 33))
    row[-1] += 1 << 40  # a step that two bytes don't hold
    asked = np.where(rng.random(3000) < 0.5, rng.choice(keys, 3000), rng.integers(-(2**63), 2**63 - 1, 3000))
    held = [(asked[:1000], row[:1000]), (asked[1000:], row[1000:])]
    model, texts = suffix_tree_lm._of_model([[keys, *weights]], 16), list(suffix_tree_lm._asked(held, 16))
    assert model.num_rows <= 16 and sum(t.num_rows for t in texts) <= 16
    both = pa.Table.from_batches([model, *texts]).to_pylist()
    both.sort(key=lambda r: (r["bucket"], r["weights"] is None))
    own = {"row": 3, "doc_id": 9, "training": True, "tokens": 2, "known": 1.0, "base": 0.5, "value": 0.25}
    table = pa.Table.from_pylist([*both, own | {"bucket": 15}], schema=suffix_tree_lm._PACKED)
    found = [r for b in suffix_tree_lm._joined(iter(table.to_batches(max_chunksize=5))) for r in b.to_pylist()]
    assert [r for r in found if r["tokens"] is not None] == [own]
    at, want = {k: j for j, k in enumerate(keys.tolist())}, {}
    for k, r in zip(asked.tolist(), row.tolist(), strict=True):
        if k in at:
            want[r] = want.get(r, 0) + np.array([w[at[k]] for w in weights])
    got = {r["row"]: (r["known"], r["base"], r["value"]) for r in found if r["tokens"] is None}
    assert set(got) == set(want) and all(np.allclose(got[r], want[r]) for r in want)


def test_suffix_tree_sums_return_in_few_rows():
    """a text's sums come from nearly every bucket; they return as bytes of many texts, not as a row for each text and task."""
    import pyarrow as pa

    rng, texts, tasks, parts = np.random.default_rng(4), 2000, 30, 8
    number = np.concatenate([np.arange(texts // 2), np.arange(texts // 2) + (7 << 33)])
    want, made = rng.random((3, texts)), []
    own = {"row": number, "doc_id": pa.array([None, *range(texts - 1)], pa.int64()), "training": number % 3 > 0, "tokens": number % 50, "known": want[0], "base": want[1], "value": want[2]}
    made += suffix_tree_lm._returned(iter([suffix_tree_lm._laid_out(texts, own, suffix_tree_lm._PARTIAL)]), parts)
    want = want.copy()
    for _ in range(tasks):
        at, sums = np.sort(rng.choice(texts, texts - 100, replace=False)), rng.random((3, texts - 100))
        want[:, at] += sums
        rows = {"row": number[at], "known": sums[0], "base": sums[1], "value": sums[2]}
        made += suffix_tree_lm._returned(iter([suffix_tree_lm._laid_out(len(at), rows, suffix_tree_lm._PARTIAL)]), parts)
    assert sum(b.num_rows for b in made) <= texts + tasks * parts
    table = pa.Table.from_batches(made).sort_by("part")
    assert set(table["part"].to_pylist()) == set(range(parts))
    found = {r["doc_id"]: r for b in suffix_tree_lm._summed(iter(table.to_batches(max_chunksize=300))) for r in b.to_pylist()}
    assert len(found) == texts
    for k, i in enumerate([None, *range(texts - 1)]):
        assert np.allclose([found[i][c] for c in ("known", "base", "value")], want[:, k])
        assert found[i]["tokens"] == number[k] % 50 and found[i]["training"] == (number[k] % 3 > 0)


def test_suffix_tree_counted_strings_meet_in_packed_buckets(monkeypatch):
    """F1 of round 3: what texts count goes to the sums as bytes of many strings, not as a row each; counts are those of a plain count."""
    import pyarrow as pa

    rng, buckets, tasks = np.random.default_rng(6), 8, 5
    suffixes, contexts = rng.integers(-(2**63), 2**63 - 1, (2, 40))
    want, made = Counter(), []
    for _ in range(tasks):
        held = []
        for longer in range(2):  # two lengths at once
            ctx, suf = rng.choice(contexts, 2000) + longer, rng.choice(suffixes, 2000)
            want.update(zip([2 + longer] * 2000, ctx.tolist(), suf.tolist(), strict=True))
            parts = [(suffix_tree_lm.hashed_pair(c, s), c, s) for c, s in zip(np.split(ctx, 4), np.split(suf, 4), strict=True)]
            held.append(parts)
        made.append(suffix_tree_lm._of_texts(held, buckets))
    assert sum(b.num_rows for b in made) <= tasks * buckets
    table = pa.Table.from_batches(made).sort_by("bucket")
    for strings in (suffix_tree_lm.STRINGS, 300):  # a bucket's strings are summed at its end, and before
        monkeypatch.setattr(suffix_tree_lm, "STRINGS", strings)
        for least in (1, 6):
            rows = [r for b in suffix_tree_lm._counted(iter(table.to_batches(max_chunksize=3)), 2, least) for r in b.to_pylist()]
            got = {(r["len"], r["ctx"], r["suf"]): r["n"] for r in rows}
            assert len(got) == len(rows) and got == {k: n for k, n in want.items() if n >= least}
    assert suffix_tree_lm._of_texts([[], [(np.arange(1), np.arange(1), np.arange(1))], []], buckets).column(4).to_pylist() == [b"\x01"]


def test_bitmaps_of_packed_keys(spark, monkeypatch):
    """F1 of round 3: bitmaps are drawn from keys packed as bytes, in parts, and are those of the same keys as rows."""
    from skein.llm import keyfilter

    keys = np.random.default_rng(8).integers(-(2**63), 2**63 - 1, 5000)
    monkeypatch.setattr(keyfilter, "PART_BITS", 1 << 12)
    monkeypatch.setattr(keyfilter, "PART_KEYS", 700)
    packed = spark.createDataFrame([(bytearray(part.tobytes()), len(part)) for part in np.array_split(keys, 40)], "keys binary, many long")
    plain = spark.createDataFrame([(int(k),) for k in keys], "key long")
    found = keyfilter.packed_key_bits(packed, "keys", "many")
    assert found.may_have(keys).all() and (found.bits == keyfilter.key_bits(plain, "key").bits).all()
    assert not keyfilter.packed_key_bits(packed.limit(0), "keys", "many").bits.any()
    assert keyfilter.packed_key_bits(packed, "keys", "many", max_bytes=1024) is None


def test_suffix_tree_levels_are_few_rows(spark):
    """F1 of round 3: the tree's strings meet their suffixes and contexts many a row; as rows of their own they cost most of its seconds."""
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(300):
        walk = [int(rng.integers(400))]
        while len(walk) < 200:
            walk.append((walk[-1] * 7 + int(rng.integers(3))) % 400)
        texts.append((True, bytearray(" ".join(f"w{k}" for k in walk).encode())))
    docs = spark.createDataFrame(texts, "training boolean, text binary").coalesce(2)
    words = suffix_tree_lm.written(suffix_tree_lm.string_counts(docs, 1, None, None).select(F.col("suf").alias("key"), "n"), "words")
    tokens, distinct = words.agg(F.sum("n"), F.count("n")).first()
    levels = suffix_tree_lm.train(docs, tokens, distinct, words, 4)
    assert len(levels) > 1
    for level in levels[1:]:
        rows, strings = level.agg(F.count("many"), F.sum("many")).first()
        assert strings > 300 and rows <= 3 * 4 * max(4, spark.sparkContext.defaultParallelism)
        assert level.filter(F.col("many") != F.octet_length("key") / 8).count() == 0


def test_texts_are_hashed_in_parts_within_a_cache():
    """F1 of round 3: parts are cut by bytes, and have all texts once; keys of strings differ."""
    import pyarrow as pa

    sizes = [0, 5, suffix_tree_lm.PART_BYTES * 3, 1, *[100] * 9000, suffix_tree_lm.PART_BYTES - 1, 0, *[0] * 2000]
    texts = pa.array([b"x" * k for k in sizes], pa.binary())
    for part in (texts, texts.slice(7, 5000), texts.slice(0, 0)):
        cut = list(suffix_tree_lm._parts(part))
        assert [k for a, n in cut for k in range(a, a + n)] == list(range(len(part)))
        assert all(1 <= n <= suffix_tree_lm.PART_TEXTS and (n == 1 or sum(map(len, part.slice(a, n).to_pylist())) <= 2 * suffix_tree_lm.PART_BYTES or max(map(len, part.slice(a, n).to_pylist())) > suffix_tree_lm.PART_BYTES) for a, n in cut)
    numbers = np.arange(300, dtype=np.int64)
    one, two = (x.ravel() for x in np.meshgrid(numbers, numbers))
    keys = suffix_tree_lm.string_keys(one, two)
    assert len(np.unique(keys)) == len(keys) and len(np.unique(suffix_tree_lm.string_keys(keys, keys[::-1].copy()))) == len(keys)
    assert 0.49 < np.unpackbits(keys.view(np.uint8)).mean() < 0.51
