"""Fill-in-middle, spelling variants and personal data against brute force, their SQL and odd rows."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import fim, labelled, pii, quality, queries, spelling, tagger, toxicity
from tests import oracle

ODD = ["", None, "a", "<P>", "x <S> y", "<M", "<<P>", "<P", ">", "a<P<P>b", "é" * 50, "日本語 text" * 300, "😀a😀" * 99, "ab" * 3_000, "\x00\x01" * 30, "same", "same", "a b", "<" * 9 + "S>"]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", i) for i, t in enumerate(texts)], "doc_id long, text string, output string, n long")


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


class TestFillInMiddle:
    def expected(self, i, text):
        text = text or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
        x, n = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), len(units)
        h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
            return i, n, "plain", None, None, text
        if h[3] % 100 < 20:
            return i, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
        return i, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"

    def test_query_equals_its_sql(self, spark, small, con):
        oracle.same(queries.op11_fill_in_middle(spark, small), con, fim.ORACLE_SQL)

    def test_odd_rows_equal_brute_force_and_come_back(self, spark):
        texts = ODD * 6 + ["long text of words, " * 20_000]
        made = fim.fill_in_middle(docs(spark, texts))
        rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(tuple(r)[:6] for r in rows) == sorted(self.expected(i, t) for i, t in enumerate(texts))
        assert {r.doc_id: r.back for r in rows} == {i: t or "" for i, t in enumerate(texts)}
        assert {r.form for r in rows} == {"plain", "psm", "spm"}

    def test_null_ids_repeated_rows_and_no_rows(self, spark):
        df = spark.createDataFrame([(None, "a b c"), (5, "d e"), (5, "d e")], "doc_id long, text string")
        assert sorted(map(str, map(tuple, fim.fill_in_middle(df).collect()))) == sorted(map(str, [self.expected(None, "a b c"), *[self.expected(5, "d e")] * 2]))
        assert fim.fim_digests(df.limit(0)).collect() == []

    def test_seed_and_shares(self, spark):
        df = docs(spark, ["one two three"] * 40)
        assert {r.form for r in fim.fill_in_middle(df, plain=0, suffix_first=100).collect()} == {"spm"}
        assert {r.form for r in fim.fill_in_middle(df, plain=100).collect()} == {"plain"}
        assert fim.fill_in_middle(df, seed=2).collect() != fim.fill_in_middle(df).collect()

    def test_any_state_is_told_by_its_last_bytes(self):
        states = {frozenset(range(7))}
        for _ in range(fim.MEMORY):
            states = {frozenset(int(fim.TABLE[s << 8 | b] >> 3) for s in some) for some in states for b in range(256)}
        assert all(len(some) == 1 for some in states)

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.text(alphabet="aZ<>PSM é日😀\n-", max_size=200), min_size=1, max_size=6), st.integers(1, 9))
    def test_scan_counts_as_patterns_do(self, texts, lanes):
        raw = [t.encode() for t in texts]
        counted = fim.scan(np.frombuffer(b"\xff".join([*raw, b""]), np.uint8), lanes)
        at = 0
        for text, r in zip(texts, raw):
            mine = counted[at : at + len(r)]
            at += len(r) + 1
            assert [(mine & bit > 0).sum() for bit in (fim.UNIT, fim.CHARACTER, fim.MARK)] == [len(re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)), len(text), len(re.findall("<[PSM]>", text))]


class TestSpellingVariants:
    def expected(self, rows, least=5, times=5, drops=199):
        counts = {}
        for i, text in rows:
            for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
                run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % drops == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] = counts.get(run, 0) + 1
        counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}

        def near(a, b):
            if len(a) == len(b):
                return sum(x != y for x, y in zip(a, b)) == 1
            a, b = sorted((a, b), key=len)
            return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

        found = {w: [v for v in counts if near(w, v)] for w in counts}
        form = {}
        for w, n in counts.items():
            best = min(found[w], key=lambda v: (-counts[v], v), default=None)
            form[w] = best if best and counts[best] >= times * n else None
        out = []
        for w, n in counts.items():
            root = w
            while form[root]:
                root = form[root]
            out.append((w, form[w], root, n, len(found[w]), counts.get(form[w])))
        return sorted(out, key=str)

    def same(self, spark, rows, **how):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
        got = spelling.spelling_groups(df, **how)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect()), key=str) == self.expected(rows, **how)

    def test_query_equals_its_sql(self, spark, small, con):
        oracle.same(queries.op12_spelling_variants(spark, small), con, spelling.ORACLE_SQL)

    def test_query_equals_brute_force(self, spark, small):
        rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
        assert sorted(map(tuple, queries.op12_spelling_variants(spark, small).collect()), key=str) == self.expected(rows)

    def test_repeated_letters_chains_ties_and_odd_rows(self, spark):
        draw = random.Random(5)
        words = ["".join(draw.choices("ab", k=draw.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "bananas", "bananass", "Éclairs", "éclairs", "ÉCLAIRS", "x×y÷zzz"]
        counts = [(w, 5 ** draw.randint(1, 3) + draw.randint(0, 1)) for w in words]
        rows = [(i % 3 or None, f"{w} " * n) for i, (w, n) in enumerate(counts)] + [(7, None), (8, ""), (9, "short"), (9, "Same1same same-Same")]
        self.same(spark, rows + rows[:9], drops=7)
        self.same(spark, rows, times=2, least=1)

    def test_a_word_of_very_many_letters(self, spark):
        word = "ab" * 20_000
        got = {r.n_near for r in spelling.spelling_groups(spark.createDataFrame([(1, f"{word} " * 5 + f"{word}c " * 5)], "doc_id long, text string"), drops=10**12).collect()}
        assert got == {1}

    def test_no_rows(self, spark):
        assert spelling.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


EMAIL, IP, CARD, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
PERSONAL = [
    "mail a.b+c@mail5.example.com. Or x@y, z@@q.r, a@b.c@d.e, a@b@c.d and @x.y", "from 8.196.197.208 not 1.2.3, 300.1.2.3, 1.2.3.4.5.6.7.8 or 1.2.3.999", "4785380592391139 and 4111 1111 1111 1111 or 4111-1111-1111-1111 not 4111111111111112",
    "+1 (743) 555-3824, +44 20 7946 0958. +1 2 or ++12345678 +12345678901234567", "4465758382889437 4465758382889437", "josé.garcía@süd.example.com", "call (743) 555-3824 or 743-555-3824", "", None, "é@ü.com 日本 1.1.1.1😀+491234567890",
]


@pytest.fixture(scope="module")
def model(spark, small):
    return pii.train(spark.read.parquet(f"{small}/documents.parquet"))


class TestPersonalData:
    def expected(self, text):
        text = text or ""
        found = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
        found += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
        found += [("card", *m.span()) for m in re.finditer(CARD, text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and self.luhn(d)]
        return found + [("phone", *m.span()) for m in re.finditer(PHONE, text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]

    def luhn(self, d):
        doubled = [int(c) if i % 2 == len(d) % 2 ^ 1 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d)]
        return sum(doubled) % 10 == 0

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet="a@.1234567890 -+()%é\n", max_size=80) | st.lists(st.sampled_from(["4111111111111111", "@", "a.b", ".", " ", "-", "+", "1.2", "255", "256", "(", ")", "7", "x", "é"]), max_size=30).map("".join))
    def test_plain_spans_equal_the_patterns(self, text):
        assert pii.base_spans(text) == self.expected(text)

    def test_plain_spans_take_time_in_proportion(self):
        began = time.time()
        for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "1 " * 500_000, "@" * 300_000, "a@" * 300_000, "+" * 500_000, "+1(" * 300_000, "a." * 300_000 + "@"):
            pii.base_spans(text)
        assert time.time() - began < 30

    def test_query_keeps_the_plain_spans_and_counts_them(self, spark, small):
        text = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
        rows = queries.op13_pii(spark, small).collect()
        assert len(rows) == len(text)
        for r in rows:
            base = self.expected(text[r.doc_id])
            written = ["%s:%d:%d" % s for s in base]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
            assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
            got = r.spans.split(",") if r.spans else []
            assert set(written) <= set(got) and len(got) == len(written) + r.n_added
            key = [(pii.KINDS.index(k), int(s)) for k, s, _ in (x.split(":") for x in got)]
            assert key == sorted(key)

    def test_network_finds_held_out_spans_and_leaves_prose_alone(self, spark, small, model):
        prose = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy(F.desc("doc_id")).limit(60).collect()]
        codes, gold = pii.training_windows(prose, count=600, seed=99)
        size = np.full(codes.shape[1], len(codes))
        got = np.zeros_like(gold)
        for lane, tag, s, e, _ in model.decode(codes, size):
            got[s:e, lane] = tag
        inside = gold > 0
        assert (got == gold)[inside].mean() > 0.85 and (got == gold)[~inside].mean() > 0.98

    def test_network_adds_what_patterns_miss(self, spark, small, model):
        prose = spark.read.parquet(f"{small}/documents.parquet").where("lang = 'en' and length(text) > 900").orderBy("doc_id").limit(9).collect()
        planted = ["4465758382889437 4465758382889437", "(743) 555-3824", "743-555-3824", "josé.garcía@süd.example.com", "2001:db8:85a3:8d3:1319:8a2e:370:7348"]
        found = 0
        for r in prose:
            at = r.text.index(" ", 300)
            for p in planted:
                (spans,) = pii.spans_of([f"{r.text[:at]} {p} {r.text[at:]}"], model)
                found += any(not plain and at < s <= at + 18 for _, s, _, plain in spans)
            (clean,) = pii.spans_of([r.text], model)
            assert all(plain for *_, plain in clean)
        assert found >= 0.7 * len(prose) * len(planted)

    def test_windows_meet(self, model):
        filler = "words of a text that goes on " * 40
        for at in range(190, 300, 7):
            text = f"{filler[:at]} 743-555-3824 {filler[at:]}"
            (spans,) = pii.spans_of([text], model)
            (whole,) = pii.spans_of([text[at - 60 : at + 60]], model)
            assert [s[2] - s[1] for s in spans] == [s[2] - s[1] for s in whole]

    def test_reconciling_joins_cut_pieces_and_keeps_the_best(self):
        spans = [(1, 10, 20, 5.0, False, True), (1, 15, 30, 6.0, True, False), (2, 18, 22, 3.0, False, False), (3, 40, 50, 1.0, False, False), (3, 45, 60, 4.0, False, False)]
        assert pii.reconciled(spans) == [(1, 10, 30, 11.0), (3, 45, 60, 4.0)]
        assert pii.reconciled([]) == []

    def test_gradients(self):
        draw = np.random.default_rng(1)
        codes, gold = draw.integers(0, tagger.CLASSES, (9, 5)), draw.integers(0, 3, (9, 5))
        model = tagger.untrained(3, hidden=4)
        _, grads = tagger.loss(model, codes, gold)
        for w, g in zip([*model.x, *model.u, model.w, model.b, model.a], grads):
            i = np.unravel_index(np.abs(g).argmax(), g.shape)
            old, sides = w[i], []
            for d in (1e-5, -1e-5):
                w[i] = old + d
                sides.append(tagger.loss(model, codes, gold)[0])
            w[i] = old
            assert abs((sides[0] - sides[1]) / 2e-5 - g[i]) < 1e-5

    def test_decoding_equals_all_paths(self):
        draw = np.random.default_rng(2)
        model = tagger.untrained(3, hidden=4)
        size = np.array([6, 6, 5, 3, 1])
        codes = draw.integers(0, tagger.CLASSES, (6, 5))
        em = model.emissions(codes, size)
        for lane, n in enumerate(size):
            alone = model.emissions(codes[:n, lane : lane + 1], np.array([n]))[:, :, 0]
            assert np.allclose(alone, em[:n, :, lane], atol=1e-5)
            paths = itertools.product(range(3), repeat=int(n))
            best = max(paths, key=lambda p: sum(alone[t, k] for t, k in enumerate(p)) + sum(model.a[i, j] for i, j in zip(p, p[1:])))
            mine = [0] * n
            for w, tag, s, e, _ in model.decode(codes, size):
                if w == lane:
                    mine[s:e] = [tag] * (e - s)
            assert tuple(mine) == best

    def test_long_runs_take_time_in_proportion(self, model):
        began = time.time()
        for text in ("x" * 300_000, "1" * 300_000, "a@" * 150_000, "a.b@c." * 50_000, "1234 " * 60_000, "+1 (" * 80_000, "a:" * 150_000, "(at)" * 80_000):
            list(pii.spans_of([text], model))
        assert time.time() - began < 60

    def test_odd_rows(self, spark, model):
        df = docs(spark, [*PERSONAL, "x" * 70_000 + " +1 (743) 555-3824", *PERSONAL]).withColumn("spans", F.lit("clash")).union(spark.createDataFrame([(None, "1.2.3.4", "en", 1, "")], "doc_id long, text string, output string, n long, spans string"))
        rows = pii.personal_data(df, model).collect()
        given = {r.doc_id: r.text for r in df.collect()}
        assert len(rows) == len(given)
        for r in rows:
            assert [(s.kind, s.start, s.end) for s in r.spans if s.plain] == self.expected(given[r.doc_id])
        assert pii.pii_digests(df.limit(0)).collect() == []


class TestClassifiersByHand:
    """Scores of whole tables against plain loops with the fitted weights."""

    def test_quality_scores_equal_a_loop_over_passages(self, spark, small):
        docs_, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
        model = quality.fit(labelled.labelled_sample(docs_, labels, "quality", quality.SAMPLE))
        w = model.weights
        sig = lambda z: 1 / (1 + math.exp(-z))

        def score(text):
            raw = text.encode("utf-8", "surrogatepass")
            bags = []
            for a in range(0, max(1, len(raw)), quality.PASSAGE):
                piece, grams, seen, kinds = raw[a : a + quality.PASSAGE], [0] * quality.TRIGRAMS, set(), [0] * 8
                for i, b in enumerate(piece):
                    nxt = raw[a + i + 1 : a + i + 3] + b"\0\0"
                    mixed = (b * 961 + nxt[0] * 31 + nxt[1]) * 2654435761 & 0xFFFFFFFF
                    grams[mixed >> 24] += 1
                    seen.add((mixed >> 20) % quality.DISTINCT)
                    kinds[quality._OF[b]] += 1
                n = max(1, len(piece))
                x = [math.sqrt(g / n) for g in grams] + [k / n for k in kinds] + [len(seen) / min(n, quality.DISTINCT), 1 / (kinds[4] / n + 0.02) / 10]
                x += [len(zlib.compress(raw, 1)) / (len(raw) + 16), math.log1p(len(raw)) / 10, math.log(n) / 10]
                x = [(v - m) / d for v, m, d in zip(x, model.mean, model.dev)]
                h = [math.tanh(sum(v * w["encode"][i, j] for i, v in enumerate(x)) + w["encode0"][j]) for j in range(quality.HIDDEN)]
                gate = [math.tanh(sum(h[i] * w["value"][i, j] for i in range(len(h)))) * sig(sum(h[i] * w["gate"][i, j] for i in range(len(h)))) for j in range(quality.ATTENTION)]
                bags.append((sum(g * w["weigh"][j] for j, g in enumerate(gate)), h))
            total = sum(math.exp(e) for e, _ in bags)
            pooled = [sum(math.exp(e) / total * h[j] for e, h in bags) for j in range(quality.HIDDEN)]
            return sig(sum(p * w["judge"][j] for j, p in enumerate(pooled)) + w["judge0"][0])

        got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, small).collect()}
        rows = docs_.collect()
        assert len(got) == len(rows)
        for r in rows[:40]:
            assert abs(got[r.doc_id].score - score(r.text or "")) < 1e-4
            assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)

    def test_toxicity_scores_equal_fresh_compressors(self, spark, small):
        docs_, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
        model = toxicity.fit(labelled.labelled_sample(docs_, labels, "toxic", toxicity.SAMPLE))

        def length(content, window):
            held = zstandard.ZstdCompressionDict(content + toxicity.CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(3, min_match=toxicity.MIN_MATCH, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False, source_size=64, dict_size=len(content) + len(toxicity.CARRIER))
            return len(zstandard.ZstdCompressor(compression_params=how, dict_data=held).compress(toxicity.CARRIER + window))

        def score(text):
            windows, now = [], []
            for word in (text or "").encode().lower().split():
                for a in range(0, len(word), toxicity.LONGEST_WORD):
                    now.append(word[a : a + toxicity.LONGEST_WORD])
                    if sum(len(x) + 1 for x in now) >= toxicity.WINDOW:
                        windows.append(b" " + b" ".join(now) + b" ")
                        now = []
            windows += [b" " + b" ".join(now) + b" "] if now else []
            gains = np.array([length(model.ordinary, x) - length(model.toxic, x) for x in windows], float)
            x = (np.array(toxicity.summary(gains)) - model.mean) / model.dev
            return 1 / (1 + math.exp(-min(30, max(-30, float(np.r_[x, 1.0] @ model.weights)))))

        got = {r.doc_id: r.score for r in queries.op3_toxicity(spark, small).collect()}
        for r in docs_.where("length(text) < 1500").orderBy("doc_id").limit(25).collect():
            assert abs(got[r.doc_id] - score(r.text)) < 1e-9
