"""Language id, quality, toxicity, token counts, chat formatting and BPE against brute force, round trips and labels."""

import base64
import hashlib
import math
import random
import re
import resource
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, labelled, langid, quality, queries, tokencount, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " \t\n", "a" * 5_000, "ab" * 3_000, "日本語のテキスト" * 300, "é" * 50, "!?" * 500, "the" * 900 + "\n" * 40, "x" * 127, "\x00\x01" * 300, "😀" * 200, " " * 3_000 + "x", "same", "same"]


def docs(spark, texts, schema="doc_id long, text string", start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


class TestBpe:
    def test_query_equals_the_library(self, spark, small, reference):
        text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
        rows = queries.op10_byte_level_bpe(spark, small).collect()
        assert len(rows) == len(text)
        for r in rows:
            ids = reference.encode_ordinary(text[r.doc_id])
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()

    def test_odd_texts_round_trip(self, spark, reference):
        coded = bpe.encode(docs(spark, ODD))
        assert {r.doc_id: r.ids for r in coded.collect()} == {i: reference.encode_ordinary(t or "") for i, t in enumerate(ODD)}
        assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(coded).collect()} == {i: (t or "").encode() for i, t in enumerate(ODD)}

    LETTERS = "abcdefghijklmnopqrstuvwxyz"

    def same(self, merger, reference, word):
        (got,) = merger.encode([word])
        assert [int(i) for ids, _, _ in got for i in ids.split(",")] == reference.encode_ordinary(word)
        assert b"".join(raw for _, raw, _ in got) == word.encode()

    def test_long_words_equal_the_library(self, reference):
        draw = random.Random(3)
        merger = bpe.Merger(bpe.vocabulary())
        for _ in range(150):
            parts = (draw.choice(self.LETTERS) * draw.randint(1, 90), "ab" * draw.randint(1, 40), "ing" * draw.randint(1, 30), "".join(draw.choices("aeionst", k=draw.randint(1, 60))))
            self.same(merger, reference, "".join(draw.choice(parts) for _ in range(draw.randint(3, 20))))
        for run in ("a", "abc", "the", "xyzzy", "日本", "=", "ha"):
            self.same(merger, reference, run * (30_000 // len(run.encode())))

    @pytest.mark.parametrize("size", [100_000, 1_000_000])
    def test_words_of_a_megabyte_take_seconds(self, reference, size):
        draw = random.Random(size)
        merger = bpe.Merger(bpe.vocabulary())
        began = time.time()
        self.same(merger, reference, "".join(draw.choices(self.LETTERS, k=size)))
        self.same(merger, reference, "ab" * (size // 2))
        assert time.time() - began < 90 * size / 1_000_000 + 10

    def test_no_files_are_written(self):
        assert bpe.Merger(bpe.vocabulary()).db.execute("SELECT current_setting('temp_directory')").fetchone() == ("",)

    def test_empty_table_null_ids_and_unknown_ids(self, spark):
        e = docs(spark, []).withColumn("ids", F.lit("clash"))
        assert bpe.encode_digests(e).count() == 0 and bpe.encode_digests(e).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        n = spark.createDataFrame([(None, "a"), (1, None)], "doc_id long, text string")
        assert sorted((r.doc_id is None, r.n_tokens) for r in bpe.encode_digests(n).collect()) == [(False, 0), (True, 1)]
        with pytest.raises(Exception, match="not in the vocabulary"):
            bpe.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>")).collect()


class TestTokenCounts:
    def brute(self, word, m):
        line = tokencount.MARK + word
        best = [(0.0, 0)]
        for i in range(1, len(line) + 1):
            size = len(line[i - 1].encode())
            options = [(-(best[i - 1][0] + size * m.byte), best[i - 1][1] + size)]
            options += [(-(best[j][0] + m.pieces[line[j:i]]), best[j][1] + 1) for j in range(i) if line[j:i] in m.pieces]
            s, n = min(options)
            best.append((-s, n))
        return best[-1][1]

    def test_trie_equals_word_by_word(self, spark, small):
        m = tokencount.unigram()
        text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
        words = sorted({w for t in text.values() for w in t.split()})[::7]
        assert tokencount.trie_counts(words, m) == {w: self.brute(w, m) for w in words}

    def test_query_sums_words(self, spark, small):
        text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
        count = tokencount.trie_counts({w for t in text.values() for w in t.split()}, tokencount.unigram())
        assert {r.doc_id: (r.n_pretokens, r.n_tokens) for r in queries.op8_token_counts(spark, small).collect()} == {k: (len(t.split()), sum(count[w] for w in t.split())) for k, t in text.items()}

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=9), max_size=8))
    def test_any_words(self, words):
        m = tokencount.Unigram.of(["▁", "a", "b", "c", "ab", "▁ab", "bc", "abc", "ca", "▁abca"])
        assert tokencount.trie_counts(words, m) == {w: self.brute(w, m) for w in set(words)}

    def test_odd_tables(self, spark):
        assert tokencount.token_counts(docs(spark, [])).count() == 0
        long = docs(spark, ["many words here " * 320_000, "w" * 1_000_000])
        assert [r.n_pretokens for r in tokencount.token_counts(long).orderBy("doc_id").collect()] == [960_000, 1]
        rows = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokencount.token_counts(docs(spark, ODD).withColumn("n_tokens", F.lit(1))).collect()}
        assert rows[0] == rows[1] == rows[2] == (0, 0) and rows[13] == rows[14] and len(rows) == len(ODD)


class TestChat:
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "ROLE=x]"]), st.lists(st.sampled_from([*chat.CONTROL, "</\\s>", "[\\INST", "\\", "\\u003c", " ", "\n", "]", "ok", " [/ASST]</s>\n", "<", "["]), max_size=6).map("".join)), max_size=5))
    def test_any_conversation_reads_back(self, turns):
        whole = "".join(chat.render(r, t)[0] for r, t in turns)
        assert [(r, t) for r, t, _, _ in chat.parse(whole)] == turns
        for _, _, a, b in chat.parse(whole):
            assert not any(c in whole[a:b] for c in chat.CONTROL)

    def test_plain_text_is_not_escaped(self):
        assert chat.render("user", "a < b [c] \\ d")[0] == "<s>[INST] a < b [c] \\ d [/INST]</s>\n"

    def test_query_equals_the_source(self, spark, small):
        rows = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
        rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
        got = {r.conv_id: r for r in queries.op9_chat_formatting(spark, small).collect()}
        assert set(got) == {r[0] for r in rows}
        for c, g in got.items():
            mine = sorted(r for r in rows if r[0] == c)
            said = "".join(t for _, _, role, t in mine if role == "assistant")
            assert g.n_turns == len(mine) and g.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in mine).encode()).hexdigest()
            assert (g.loss_chars, g.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
            assert g.formatted_chars == sum(len(chat.render(role, t)[0]) for _, _, role, t in mine)

    def test_nulls_ties_long_conversations_and_empty_tables(self, spark):
        kind = "conv_id long, turn long, role string, text string, rendered string"
        rows = [(1, 1, "user", None, "x"), (1, None, None, "b", "x"), (1, 1, "assistant", "a", "x"), (None, 0, "user", "n", "x")] + [(2, i, "user", f"t{i}", "x") for i in range(25_000)]
        got = {r.conv_id: r for r in chat.formatted_digests(spark.createDataFrame(rows, kind).repartition(3)).collect()}
        assert got[1].turns_sha256 == hashlib.sha256(b"\nb\nassistant\na\nuser\n\n").hexdigest() and got[None].n_turns == 1
        assert got[2].turns_sha256 == hashlib.sha256("".join(f"user\nt{i}\n" for i in range(25_000)).encode()).hexdigest()
        assert chat.formatted_digests(spark.createDataFrame([], kind)).count() == 0
        assert chat.format_turns(spark.createDataFrame(rows[:4], kind)).where("loss").count() == 1


class TestClassifiers:
    @pytest.mark.parametrize("query,label,least", [(queries.op2_quality_classifier, "quality", 0.97), (queries.op3_toxicity, "toxic", 0.9)])
    def test_held_out_accuracy(self, spark, query, label, least):
        d = "/root/testdata/sf0.01"
        rows = query(spark, d).toPandas()
        truth = spark.read.parquet(f"{d}/labels.parquet").toPandas().merge(rows, on="doc_id")
        assert len(rows) == 1_000 and (rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]).all()
        held = truth[truth["held_out"]]
        assert (held["predicted"] == held[label]).mean() >= least
        assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= (0.3 if label == "quality" else 0.5))).all()

    def test_samples_never_hold_held_out_rows(self, spark):
        d = docs(spark, [f"text {i}" for i in range(500)])
        labels = spark.createDataFrame([(i, i % 2, 0) for i in range(500)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
        s = labelled.labelled_sample(d, labels, "quality", {1: 50, 0: 1_000})
        used = [int(t.split()[1]) for t in s["text"]]
        assert all(zlib.crc32(str(i).encode()) % 5 for i in used) and (s["y"] == 1).sum() == 50 and (s["y"] == 0).sum() > 150
        assert s.equals(labelled.labelled_sample(d.repartition(7), labels, "quality", {1: 50, 0: 1_000}))

    @pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
    def test_odd_texts_and_missing_labels(self, spark, module, label):
        score = module.quality_scores if module is quality else module.toxicity_scores
        none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        rows = score(docs(spark, ODD).withColumn("score", F.lit("clash")), none).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
        words = docs(spark, [("good plain words here " if i % 2 else "BAD!! *** ### ") * 20 for i in range(40)])
        assert score(words.unionByName(docs(spark, ODD, start=100)), some).count() == 40 + len(ODD)
        assert score(docs(spark, []), some).count() == 0

    def test_attention_weights_sum_to_one_and_gradients_are_right(self):
        rng = np.random.default_rng(0)
        rows = pd.DataFrame({"text": ["fine words and more " * 60, "*** ### $$$ " * 90] * 20, "y": [1, 0] * 20})
        m = quality.fit(rows)
        assert math.isclose(m.attention(rows["text"][0]).sum(), 1, rel_tol=1e-5)
        x, count = rng.standard_normal((7, quality.WIDTH)), np.array([3, 4])
        w = {k: rng.standard_normal(v.shape) * 0.1 for k, v in m.weights.items()}
        y = np.array([1.0, 0.0])
        loss = lambda: -np.mean(y * np.log(quality._forward(w, x, count)[0]) + (1 - y) * np.log(1 - quality._forward(w, x, count)[0]))
        g = quality._gradients(w, x, count, y)
        for k in w:
            at = tuple(rng.integers(0, n) for n in w[k].shape)
            old, e = w[k][at], 1e-5
            w[k][at] = old + e
            up = loss()
            w[k][at] = old - e
            down = loss()
            w[k][at] = old
            assert math.isclose((up - down) / (2 * e), g[k][at], rel_tol=1e-3, abs_tol=1e-7), k

    def test_a_score_does_not_depend_on_other_texts(self):
        rows = pd.DataFrame({"text": ["fine words and more " * 60, "*** ### $$$ " * 90] * 20, "y": [1, 0] * 20})
        for module in (quality, toxicity):
            score = module.fit(rows).scorer()
            texts = ["one text", "another *** text", "x" * 3_000]
            assert np.allclose(score(texts), [score([t])[0] for t in texts])

    def test_a_long_text_is_scored_a_slice_at_a_time(self, monkeypatch):
        texts = ["fine words and émore " * 30_000, "short", "", "x" * quality.SLICE, "y" * (quality.SLICE + 1), "z" * 700]
        sliced = quality.passages(texts)
        monkeypatch.setattr(quality, "SLICE", 1 << 40)
        at_once = quality.passages(texts)
        assert (sliced[0] == at_once[0]).all() and (sliced[1] == at_once[1]).all()

    @pytest.mark.parametrize("module", [quality, toxicity])
    def test_texts_of_twenty_megabytes(self, module):
        rows = pd.DataFrame({"text": ["fine words and more " * 60, "*** ### $$$ " * 90] * 20, "y": [1, 0] * 20})
        score = module.fit(rows).scorer()
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        began = time.time()
        (p,) = score(["fine words and more " * 1_000_000])
        assert 0 <= p <= 1 and time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # kB

    @pytest.mark.parametrize("module", [quality, toxicity])
    def test_a_score_at_the_threshold(self, spark, module):
        none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        d = docs(spark, ["one text", "another", "another"])
        score = module.quality_scores if module is quality else module.toxicity_scores
        at = score(d, none).first().score
        assert [r.predicted for r in score(d, none, threshold=at).collect()] == [1, 1, 1]
        kept = module.without_poor(d, none, threshold=at) if module is quality else module.without_toxic(d, none, threshold=at)
        assert kept.count() == (3 if module is quality else 0)

    def test_all_ordinary_texts_can_be_in_the_dictionary(self, monkeypatch):
        seen = []
        monkeypatch.setattr(toxicity, "_train", lambda size, samples: seen.append(samples) or b" " * 8)
        rows = pd.DataFrame([(f"common early{i % 7} n{i}", 0) for i in range(2_000)] + [(f"common later{i % 7} n{i}", 0) for i in range(2_000, 4_000)] + [(f"vilewords{i}", 1) for i in range(40)], columns=["text", "y"])
        toxicity.fit(rows)
        toxicity.fit(rows, ordinary_words=600)
        assert len(seen[1]) == 12_000 and sum(b"later" in w for w in seen[1]) == 2_000
        assert len(seen[7]) == 600 and 50 < sum(b"later" in w for w in seen[7]) < 150  # each fit trains on all texts, then without either fold


class TestLanguages:
    def test_query(self, spark):
        d = "/root/testdata/sf0.01"
        rows = queries.op1_language_id(spark, d).toPandas()
        assert len(rows) == 250 and (rows["lang"] == rows["declared"]).mean() > 0.97 and (rows["text_lang"] == rows["declared"]).mean() > 0.9
        assert rows["posterior"].between(0, 1).all()

    def test_evidence_is_fused(self, spark, small):
        d = spark.read.parquet(f"{small}/documents.parquet")
        german = d.where("lang = 'de'").first().text[:1500]
        rows = [(0, "https://a.example.de/x", None), (1, "https://h.example.org/1", "<html lang='fr'><p>1 2 3</p></html>"), (2, None, None), (3, "nonsense", "<html><p>" + german + "</p></html>"), (None, "https://h.example.org/2", "")] + [(10 + i, "https://h.example.org/3", "<html lang='fr'></html>") for i in range(20)]
        got = {r.page_id: r for r in langid.languages_of(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("clash")), d).collect()}
        assert len(got) == len(rows)
        assert got[0].lang == "de" and got[1].lang == "fr" and got[3].lang == "de"  # suffix; declaration; text
        assert got[None].lang == "fr"  # nothing of its own: its host's other pages
        assert got[2].host == ""

    def test_empty_table(self, spark, small):
        e = spark.createDataFrame([], "page_id long, url string, html string")
        assert langid.languages_of(e, spark.read.parquet(f"{small}/documents.parquet")).count() == 0

    def brute(self, rows, model, languages=langid.LANGUAGES):
        """page -> posterior of each language, by sums over all other pages for each page and level."""
        n, pages = len(languages), []
        for page, url, text in rows:
            host = (re.match(r"[a-z]+://([^/]+)", url or "") or [None, ""])[1]
            parts = host.split(".")
            domain = ".".join(parts[-3:] if len(parts) > 2 and len(parts[-1]) == 2 and parts[-2] in langid.REGISTRIES else parts[-2:])
            g = langid.grams(langid.visible(text or ""))
            e = model[:, g].sum(1) * min(1.0, langid.MOST_GRAMS / max(1, len(g)))
            for named, sure in ((langid.declared_language(text or ""), langid.DECLARED), (langid.SUFFIXES.get(parts[-1]), langid.SUFFIX)):
                if named in languages:
                    e = e + np.log([sure if x == named else (1 - sure) / (n - 1) for x in languages])
            p = np.exp(e - e.max())
            pages.append((page, {"all": 0, "suffix": parts[-1], "domain": domain, "host": host}, e - e.max(), p / p.sum()))
        found = {}
        for page, at, e, p in pages:
            prior = np.full(n, 1 / n)
            for level, k in (("all", float(n)), *langid.SMOOTHING.items()):
                mine = [q for _, other, _, q in pages if other[level] == at[level]]
                prior = (np.sum(mine, 0) - p + k * prior) / (len(mine) - 1 + k)
            q = np.log(prior) + e
            q = np.exp(q - q.max())
            found[page] = q / q.sum()
        return found

    def test_priors_equal_brute_force(self, spark, small):
        d = spark.read.parquet(f"{small}/documents.parquet")
        rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
        rows += [(10_000 + i, f"https://{h}/x", None) for i, h in enumerate(["www.one.org", "blog.one.org", "one.org", "a.two.co.uk", "b.two.co.uk", "c.three.co.uk", "single.de", "localhost"])]
        rows += [(10_100, "https://www.one.org/", "<html lang='es'>uno dos tres"), (10_101, "https://www.one.org/", "<html lang='es'>uno dos tres")]
        want = self.brute(rows, langid.text_model(d))
        got = {r.page_id: r for r in langid.languages_of(spark.createDataFrame(rows, "page_id long, url string, html string"), d).collect()}
        assert len(got) == len(rows)
        for page, q in want.items():
            assert got[page].lang == langid.LANGUAGES[int(q.argmax())] and abs(got[page].posterior - q.max()) < 2e-6

    @pytest.mark.parametrize("host,domain", [("www.example.com", "example.com"), ("a.b.example.co.uk", "example.co.uk"), ("example.co.uk", "example.co.uk"), ("co.uk", "co.uk"), ("localhost", "localhost"), ("", ""), ("x.net.de", "x.net.de"), ("a.b.net.com", "net.com")])
    def test_registered_domain(self, spark, host, domain):
        assert spark.createDataFrame([(host,)], "h string").select(langid.registered_domain(F.col("h")).alias("d")).first().d == domain

    @pytest.mark.parametrize("page", ["<nav>", "<", "<!--", "<html ", "<script>", "a <b> ", "</nav  ", "<html lang=  ", "<style><!-- "])
    def test_unclosed_markup_takes_linear_time(self, page):
        began = time.time()
        langid.visible(page * (5_000_000 // len(page)))
        langid.declared_language(page * (5_000_000 // len(page)))
        assert time.time() - began < 30

    def test_what_is_visible(self):
        assert langid.visible("a<!-- x -->b<nav>z <p></nav >c &amp; <p x>d<nav>e < f").split() == ["a", "b", "c", "&", "d", "e", "<", "f"]
        assert langid.visible("<!-- never closed <p>a") .split() == ["a"]
        assert langid.declared_language("a < b <html lang='fr'") == "fr" and langid.declared_language("<html lang = \"DE-at\">") == "de"

    def test_ties_go_by_the_order_of_languages_and_repeated_rows_count(self, spark, small):
        rows = [(1, None, None), (1, None, None), (2, None, "")]
        got = langid.languages_of(spark.createDataFrame(rows, "page_id long, url string, html string"), spark.read.parquet(f"{small}/documents.parquet")).collect()
        assert [(r.lang, r.posterior, r.n_host) for r in got] == [(langid.LANGUAGES[0], 0.25, 3)] * 3

    def test_a_late_html_tag_declares(self, spark, small):
        late = {1: "<!-- " + "licence " * 1_000 + "-->", 2: "<?xml version='1.0'?>" + " \n" * 3_000, 3: "plain words " * 500, 4: "<!-- <html lang='de'> -->" * 300, 5: "<script>x = \"<html lang='de'>\"</script>" * 300}
        rows = [(i, f"https://h{i}.example.org/", lead + "<html class='a' lang='fr'><p>1 2 3</p></html>") for i, lead in late.items()]
        rows += [(6, "https://h6.example.org/", "<html><p>1 2 3</p></html><!-- <html lang='de'> -->")]
        got = {r.page_id: r for r in langid.languages_of(spark.createDataFrame(rows, "page_id long, url string, html string"), spark.read.parquet(f"{small}/documents.parquet")).collect()}
        assert {i: r.declared for i, r in got.items()} == {**{i: "fr" for i in late}, 6: None}
