"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows
and columns with clashing names, and on empty tables."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curatrix.llm import chat_format, decontaminate, line_dedup, packing, quality, secrets, simhash, substring_dedup, token_output, tokens, url_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, kept string, fp string, gone string, n_lines string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or ""), "k", "x", "f", "g", "l") for i, t in rows], SCHEMA)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "to", "Éa", "naïve", "x1", "data", "alpha", "beta", "gamma", "delta", "omega", "q"]
    out = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(rng.choice((1, 4, 40, 90, 300))))) for i in range(60)]
    passage = " ".join(f"w{k}" for k in range(60))
    out += [(100 + i, f"{out[i][1]} {passage}\n{out[i + 1][1]}") for i in range(8)]
    out += [(200 + i, out[3][1]) for i in range(3)] + [(300, out[12][1] + " extra"), (301, None), (302, ""), (303, " \t\n "), (304, "a"), (304, "a"), (305, "lone lone " * 4000), (None, out[5][1]), (None, None), (306, "tab\tand\r\nline  two\x0bthree \x1f four")]
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text: str | None) -> int:
    from xxhash import xxh64_intdigest as h

    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    hs = [h(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs))


def test_simhash(spark, rows):
    fps = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    expected = collections.Counter((i, fps[k], min((rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None), default=None)) for k, (i, _) in enumerate(rows))
    got = simhash.simhash_components(table(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == expected
    kept = simhash.drop_near_duplicates(table(spark, rows), shingle=3)
    assert kept.columns == table(spark, rows).columns and kept.count() == len(set(group))
    assert simhash.simhash_components(table(spark, [])).count() == 0 and simhash.drop_near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("kind", [simhash.COARSE, simhash.FINER])
def test_simhash_links_in_blocks(spark, kind):
    """A dense cell that is compared in many small blocks gives the components of brute force."""
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base for _ in range(60)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, 7, kind)).collect()}
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    mine = [roots.get(s[0], s[0]) for s in signed]
    assert all((group[a] == group[b]) == (mine[a] == mine[b]) for a in range(len(fps)) for b in range(a))


def test_cells_meet_all_neighbours(spark):
    """Any two fingerprints within three bits share a cell in which one of them is at home; neighbours are one step away."""
    rng = random.Random(2)
    pairs = [(a, a ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))) for a in (rng.getrandbits(64) for _ in range(150))]
    pairs += [(0, 7), (2**64 - 1, 2**64 - 8), (0, 1 << 63), (3 << 62, 0)]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame(sorted({(signed(f),) for p in pairs for f in p}), "fp long")
    for kind in (simhash.COARSE, simhash.FINER):
        stands = collections.defaultdict(dict)
        for r in simhash.cells(df, kind).collect():
            stands[r.fp][(r.grid, r.cell)] = r.home
        assert all(sum(x.values()) == len(simhash.grids(*kind)) for x in stands.values())
        for a, b in pairs:
            one, two = stands[signed(a)], stands[signed(b)]
            assert any(one[c] or two[c] for c in one.keys() & two.keys()), (a, b)


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    b[:250] = a[:250] ^ (np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64))
    got = simhash.manhattan(simhash._vector(a), simhash._vector(b))
    counts = lambda x: [(int(x) >> k & 1) + (int(x) >> k + 1 & 1) for k in range(0, 64, 2)]
    assert got.tolist() == [sum(abs(p - q) for p, q in zip(counts(x), counts(y))) for x, y in zip(a, b)] and (got <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "missing"])
def test_encoder(rows, name):
    if name == "missing":
        pytest.raises(Exception, tokens.encoder, "/nowhere.json")
        return
    enc = tokens.Encoder(P.path(name), remembered=50)
    texts = [t or "" for _, t in rows] + ["\n", " a", "a ", "a\n\nb", "a \n b", "it's\x01 \x01", "x\xa0 y", "<|endoftext|>", "é e\u0301 ΑΣ", "\x00a"]
    plain = Tokenizer.from_file(P.path(name))
    for _ in range(2):
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_simple8b_round_trip():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = rng.integers(0, 900, 4)
        ids = rng.integers(0, 2**63, lengths.sum()).astype(np.uint64) * np.uint64(2) >> rng.integers(0, 64, lengths.sum()).astype(np.uint64)
        coded, by_doc, by_block = token_output.encode_blocks(ids, lengths)
        starts = np.cumsum(by_block) - by_block
        assert np.array_equal(token_output.decode_blocks(coded, starts), ids) and by_doc.sum() == len(coded) == by_block.sum()
        if len(starts) > 1:
            assert np.array_equal(token_output.decode_blocks(coded[starts[1] : starts[2] if len(starts) > 2 else None], np.array([0])), ids[min(lengths[lengths > 0][0], token_output.BLOCK) :][: min(token_output.BLOCK, lengths[lengths > 0][0] - token_output.BLOCK) if lengths[lengths > 0][0] > token_output.BLOCK else min(token_output.BLOCK, lengths[lengths > 0][1])])
    assert len(token_output.encode_blocks(np.zeros(240, np.uint64), np.array([240]))[0]) == 4


def test_token_output(spark, rows):
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(token_output.read_digests(token_output.write_tokens(table(spark, rows), P.path("byte_bpe_50k.json"))).collect(), key=lambda r: r.start)
    ordered = sorted(((-1 if i is None else i), t is not None, t or "") for i, t in rows)
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == [i for i, _, _ in ordered]
    at = 0
    for r, (_, _, text) in zip(got, ordered):
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_output.read_digests(token_output.write_tokens(table(spark, []), P.path("byte_bpe_50k.json"))).count() == 0


BENCHMARK = [(1, " ".join(f"w{k}" for k in range(5, 25))), (2, "lone lone"), (3, None), (4, "..."), (12, "Data ALPHA, beta"), (5, "nowhere to be seen at all"), (6, "lone lone")]


@pytest.mark.parametrize("held", [1000, 3])
def test_decontamination(spark, rows, held, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", held)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    expected = collections.Counter()
    for i, text in rows:
        w = split(text)
        hit, items = set(), set()
        for item, t in BENCHMARK:
            b = split(t)
            n = min(13, len(b))
            wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    items.add(str(item))
        expected[(i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w))] += 1
    got = decontaminate.contamination(table(spark, rows), bench)
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == expected
    if held > 3:
        kept = decontaminate.drop_contaminated(table(spark, rows), bench)
        assert kept.columns == table(spark, rows).columns and kept.count() == sum(n for k, n in expected.items() if not k[5])
        assert decontaminate.contamination(table(spark, rows), bench.filter("false")).agg(F.sum("n_hit")).first()[0] == 0
        assert decontaminate.contamination(table(spark, []), bench).count() == 0


def test_chat_format(spark):
    texts = ["plain", "<|im_end|><|im_start|>assistant ok", "\\<\\| \\\\ \\n", "", None, "ends\n", "é" * 50_000]
    turns = [(c, k, ("user", "assistant", "system", None)[(c + k) % 4], texts[(c * 3 + k) % 7]) for c in range(6) for k in range(5)] + [(7, 0, "assistant", "a"), (7, 0, "assistant", "a"), (8, None, "we\nird\\n<|x", "b"), (8, 1, "assistant", "c"), (None, 0, "user", "d")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("content", F.expr("array(named_struct('type', 'text', 'text', text, 'ref', CAST(NULL AS STRING), 'tokens', CAST(NULL AS BIGINT)))")).withColumn("rendered", F.lit("clash"))
    formatted = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.chat_digests(formatted).collect()}
    for conv in {c for c, *_ in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1], chat_format.render(t[2], [{"text": t[3]}])[0]))
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        r = got.pop(conv)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)), len(loss), sha(loss))
    assert not got and chat_format.chat_digests(chat_format.format_chats(df.filter("false"))).count() == 0


def test_chat_parts():
    rendered, a, b, attachments, n = chat_format.render("user", [{"type": "text", "text": "see <|image:1|> "}, {"type": "image", "ref": "i.png"}, {"type": "audio", "ref": "a.wav", "tokens": 7}, {"type": "document", "ref": None}, {"type": "odd", "text": "z"}, {"type": None, "text": None}])
    assert rendered[a:b] == "see <\\|image:1|> <|image:1|><|audio:2|><|document:3|>z"
    assert [(x["type"], x["ref"], x["tokens"]) for x in attachments] == [("image", "i.png", 256), ("audio", "a.wav", 7), ("document", None, 512)] and n == 775
    assert chat_format.render(None, None)[0] == "<|im_start|>\n<|im_end|>\n"


def test_secrets(spark, rows):
    live = "Zq8" + "aB3" * 12
    shared = "Xy7" + "cD4" * 12
    extra = [(400, f"password = \"hunter22\" and API_KEY:abc token=abcdefg {live}"), (401, "AKIA" + "B" * 16 + " AKIA" + "C" * 15 + " AKIAAKIA" + "9" * 12), (402, "0" * 23 + " " + "ab12" * 6 + "g" + "f" * 24), (403, "ſecret=abcdefgh Secret='abcdefgh'  toKen :  ======")]
    extra += [(410 + k, f"{shared} é {'deadbeef' * 3}") for k in range(4)]
    every = rows + extra
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))
    got = collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan_secrets(table(spark, every), F.col("source"), F.col("source")).collect())
    expected = collections.Counter()
    for i, t in every:
        spans = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(kinds) for m in p.finditer(t or "") if ok(m))
        expected[(i, *(sum(s[1] == k for s in spans) for k in range(3)), sha(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)))] += 1
    assert got == expected
    by = {r.doc_id: r for r in secrets.scan_secrets(table(spark, extra), F.col("source"), F.col("source")).collect()}
    assert "mixed" in by[400].spans and all("mixed" not in by[410 + k].spans and by[410 + k].n_examples == 2 and "hex:42:66" in by[410 + k].spans for k in range(4))
    assert secrets.scan_secrets(table(spark, []), F.col("source"), F.col("source")).count() == 0


def test_secret_ownership_is_brute_force(spark):
    """Spans and ownership of random tokens in documents of several owners and repositories."""
    rng = random.Random(9)
    token = lambda: "".join(rng.choice("aB3cD4+/_=-") for _ in range(rng.choice((20, 31, 32, 40, 60))))
    pool = [token() for _ in range(30)]
    docs = [(i, " ".join(rng.choice([lambda: rng.choice(pool), lambda: "plain é text", lambda: f"token={rng.choice(pool)}", lambda: "f" * 24, lambda: f"AKIA{'Q' * 16}x"])() for _ in range(rng.randrange(0, 6))), f"o{rng.randrange(4)}", f"r{rng.randrange(5)}") for i in range(80)]
    docs += [(90, None, None, None), (91, "", "o1", None)]
    spans, holders = {}, collections.defaultdict(set)
    for i, t, owner, repo in docs:
        mine = sorted((m.start(), k, m.end(), m[2] if k == 0 else m[0]) for k, p in ((0, secrets.ASSIGN), (1, secrets.ACCESS), (2, secrets.HEX)) for m in p.finditer(t or "") if k or len(m[2]) >= 6)
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32,}", t or ""):
            v = m[0]
            if re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v) and not any(a < m.end() and m.start() < b for a, k, b, _ in mine if k < 3):
                mine.append((m.start(), 3, m.end(), v))
        spans[i] = sorted(mine)
        for s in mine:
            holders[s[3]].add((owner or "", f"{owner or ''}/{repo or ''}"))
    figures = {v: (len({o for o, _ in x}), len({r for _, r in x})) for v, x in holders.items()}
    live = {v: o < 3 and r < 4 for v, (o, r) in figures.items()}
    assert {k for k in live.values()} == {True, False} and any(o < 3 <= 4 <= r for o, r in figures.values())
    df = spark.createDataFrame(docs, "doc_id long, text string, owner string, repo string")
    repo = F.concat(F.coalesce("owner", F.lit("")), F.lit("/"), F.coalesce("repo", F.lit("")))
    got = {r.doc_id: r for r in secrets.scan_secrets(df, repo, F.col("owner"), example_repositories=4).collect()}
    for i, mine in spans.items():
        shown = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, v in mine if k < 3 or live[v])
        most = [max((figures[v][n] for *_, v in mine), default=0) for n in (0, 1)]
        assert (got[i].spans, got[i].n_live, got[i].n_examples, [got[i].most_owners, got[i].most_repositories]) == (shown, sum(live[s[3]] for s in mine), sum(not live[s[3]] for s in mine), most), i


def brute_repeats(rows, n=35):
    seen = collections.Counter(tuple(w[k : k + n]) for w in (words(t) for _, t in rows) for k in range(len(w) - n + 1))
    out = collections.Counter()
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        out[(i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    return out


def test_substring_dedup(spark, rows, monkeypatch):
    got = substring_dedup.remove_repeats(table(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows)
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0


def test_rolling_and_anchors():
    rng = random.Random(2)
    docs = [[bytes([97 + rng.randrange(3)]) for _ in range(n)] for n in (0, 200, 34, 35, 0, 120, 1, 0)]
    w = substring_dedup.Windows(docs, substring_dedup.WordHashes())
    h = [int(x) for x in w.h]
    base, m = int(substring_dedup._B1), 1 << 64
    hashes = substring_dedup.rolling(w.h, 35, substring_dedup._B1)
    flat = [x for d in docs for x in d]
    for i in np.flatnonzero(w.starts).tolist():
        value = 0
        for x in h[i : i + 35]:
            value = (value * base + x) % m
        assert int(hashes[i]) == value
        for j in range(i, i + 13):  # the window's spans of twelve runs
            span = w.grams[j : j + 12]
            assert w.spans[j] and w.least[j] == span.min() and w.is_anchor[j + int(span.argmin())]
    assert int(w.starts.sum()) == sum(max(0, len(d) - 34) for d in docs) and len(flat) == len(h)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q#f", "https://example.com/en/6", "http://notexample.com/en/7", "http://x.net/de/1", "http://b.example.net/de/80", "http://example.net/de/", "http://org/es/", "http://evil.org/x.com/en/", "ftp://com/en", "http://com/en/", "a://b://c.com/en/", "http://h.org?x=/es/", "http://spam-farm.example.org/z", "http://é.com/en/" + "y" * 5000, "http://x.fr/wp-login.php", "http://x.fr/wp-login.php5"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))).orderBy("page_id").collect()]
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    for url, (host, path, rule, verdict) in zip(urls, got):
        h, p = url_rules.split_url(url)
        fits = [(len(a + b), a + b, v) for a, b, v in rules if ("." + h).endswith("." + a) and p.startswith(b)]
        assert (host, path, rule) == (h, p, max(fits)[1] if fits else None)
        if fits:
            assert verdict == max(fits)[2]
    df = spark.createDataFrame([(1, "http://com/en/"), (1, "http://com/en/"), (None, None)], "page_id long, url string")
    assert sorted((r.page_id or 0, r.verdict) for r in url_rules.judge_urls(df).collect()) == [(0, "allow"), (1, "block"), (1, "block")] and url_rules.judge_urls(df.filter("false")).count() == 0
    many = tuple(url_rules.Rule("block", f"*.h{k}.*/x{k}**") for k in range(3000))
    assert [r.verdict for r in url_rules.judge_urls(spark.createDataFrame([(1, "http://a.h7.org/x7y"), (2, "http://a.h7.org/x8")], "page_id long, url string"), (), many).orderBy("page_id").collect()] == ["block", "allow"]
    assert got[15][3] == "block" and got[17][3] == "block" and got[18][3] == "allow" and got[0] == ("", "", None, "allow") and got[13][:2] == ("b:", "//c.com/en/")


def test_globs_match_regular_expressions():
    rng = random.Random(4)
    globs = ["".join(rng.choice(["a", "b", "/", "?", "*", "**", "ab"]) for _ in range(rng.randrange(1, 12))) for _ in range(70)]
    texts = ["".join(rng.choice("ab/é") for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    fits = url_rules.Automaton(tuple(url_rules.Rule("block", g) for g in globs)).run(texts)
    for k, g in enumerate(globs):
        p = re.compile("".join({"**": "[\\s\\S]*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|\*|\?|[^*?]", g)))
        assert [bool(x) for x in fits[:, k]] == [bool(p.fullmatch(t)) for t in texts], g


def test_line_dedup(spark):
    unique = [f"{k} line number alpha{k} stands here only once beta" for k in "abcdefghijklmnopqrstuvwxyz"]
    docs = [(i, f"{unique[i]} x{chr(97 + i)}\nAll rights reserved by us {2000 + i}.\nend {unique[-i - 1]}") for i in range(13)]
    docs += [(50 + i, f"{unique[i]}\nPosted by user {name} on the main board today\n{unique[-i - 1]} tail") for i, name in enumerate("Ann Bob Cid Dan Eva Fay Gus Hal Ida Joe Kim Lea".split())]
    copy = "First line of a copied page\nSecond line of a copied page\nThird line of it all\nFourth line of that page\nFifth and last line here"
    docs += [(100 + i, copy) for i in range(40)] + [(200 + i, copy.replace("all", f"all v{'x' * i}")) for i in range(12)] + [(300, None), (301, ""), (302, "\n\n"), (303, "a b c " * 20000), (None, "z")]
    df = table(spark, docs)
    got = line_dedup.drop_template_lines(df)
    assert set(got.columns) == {*df.columns, "n_lines_", "n_dropped"} and got.count() == len(docs)
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
    for i, text in docs[:25]:
        first, _, last = text.split("\n")
        assert by[i][0].text == f"{first}\n{last}" and by[i][0].n_dropped == 1 and by[i][0].n_lines_ == 3, by[i]
    for i, text in docs[25:]:
        assert all(r.text == text and r.n_dropped == 0 for r in by[i]), i
    assert line_dedup.drop_template_lines(table(spark, [])).count() == 0


def test_quality(spark, rows):
    got = quality.quality_rules(table(spark, rows))
    assert "kept_" in got.columns and got.columns[: len(SCHEMA.split(","))] == table(spark, rows).columns
    expected = collections.Counter()
    for i, t in rows:
        w, t = words(t), t or ""
        runs = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = len({j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)})
        lines = [x for x in t.split("\n") if words(x)]
        expected[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w))] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()) == expected
    assert quality.drop_low_quality(table(spark, rows)).count() == got.filter("kept_").count() and quality.quality_rules(table(spark, [])).count() == 0


def test_js_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.0, 0.75]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    expected = (sum(a * np.log2(a / c) for a, c in zip(p, m) if a) / 2 + sum(b * np.log2(b / c) for b, c in zip(q, m) if b) / 2) ** 0.5
    row = spark.range(1).select(quality.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d"), quality.js_distance(F.lit(None).cast("array<double>"), F.array(*map(F.lit, q))).alias("n")).first()
    assert row.d == pytest.approx(expected) and row.n is None


def test_junk_is_rejected_and_prose_kept(spark):
    prose = """The committee met in the morning to hear what the engineers had found, and it was clear that the bridge could not be opened for the
    summer. Of the four piers in the river, two had moved, and the older of them was leaning to the west with a crack that ran from the water to the deck.
    The mayor asked for a second report and promised that the town would pay for it. In the afternoon the council voted to keep the road closed, and a
    small group of residents walked to the bank to see the damage for themselves."""
    texts = [prose, " ".join(f"{w}### &&&{k}$$$" for k, w in enumerate(prose.split())), " ".join(f"zx{chr(97 + k % 26)}q{k}" for k in range(100))]
    got = [r.kept for r in quality.quality_rules(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).orderBy("doc_id").collect()]
    assert got == [True, False, False]


def test_packing(spark, rows):
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    df = table(spark, rows)
    got = packing.pack_documents(df, P.path("word_bpe_49k.json"), window=256).collect()
    per_doc, per_sequence = collections.Counter(), collections.defaultdict(list)
    for r in got:
        per_sequence[r.sequence_id].append((r.offset, r.length))
        per_doc[(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
    expected = collections.Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        for a in range(0, len(ids), 256):
            expected[(i, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes()), len(ids))] += 1
    assert per_doc == expected
    filled = 0
    for pieces in per_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
        filled += at
    least = -(-filled // 256)
    assert least <= len(per_sequence) <= least + 2 and sorted(per_sequence) == list(range(len(per_sequence)))
    assert packing.pack_documents(table(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_packed_sequences(spark):
    df = spark.createDataFrame([(i, "word " * (i * 7)) for i in range(12)], "doc_id long, text string")
    path = P.path("word_bpe_49k.json")
    packed = packing.pack_documents(df, path, window=64)
    made = {r.sequence_id: r for r in packing.sequences(df, packed, path, window=64).collect()}
    for s, r in made.items():
        assert len(r.ids) == packing.padded_length(r.filled, 64)
    for p in packed.collect():
        part = made[p.sequence_id].ids[p.offset : p.offset + p.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32


def test_patterns_are_shortest_pack_first():
    """Piece by piece, longest first, into the pack that holds least, gives packs of the same lengths."""
    rng = random.Random(7)
    assert packing.pack_histogram({70: 1, 50: 1, 20: 1}, 100) == [(1, (70,)), (1, (50, 20))]
    for _ in range(150):
        counts = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(rng.randrange(1, 25))}
        packs: list[list[int]] = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                room = [p for p in packs if sum(p) + length <= 64]
                if room:
                    min(room, key=sum).append(length)
                else:
                    packs.append([length])
        filled = collections.Counter()
        for n, lengths in packing.pack_histogram(counts, 64):
            filled[sum(lengths)] += n
        assert filled == collections.Counter(map(sum, packs))


def test_histogram_packing_keeps_every_piece():
    rng = random.Random(6)
    for _ in range(50):
        counts = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))}
        patterns = packing.pack_histogram(counts, 64)
        placed = collections.Counter()
        for n, lengths in patterns:
            assert sum(lengths) <= 64 and n > 0
            for x in lengths:
                placed[x] += n
        assert placed == counts
    assert packing.pack_histogram({}, 64) == []


def test_json_stays_text():
    assert json.loads(json.dumps(chat_format.unescape(chat_format.escape('{"a":"<|b\\\\"}')))) == '{"a":"<|b\\\\"}'
