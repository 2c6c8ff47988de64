"""BPE, fingerprints, HTML, chats, languages and toxicity: brute force, round trips, held-out accuracy and odd rows."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from sessionloom.llm import op2_bpe, op3_fingerprint, op4_html, op5_chat, op7_langid, op9_toxicity
from sessionloom.llm.common import table

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, sf_dir, library):
    random.seed(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "\n\n", "\t", " \n", "'s", "'ll", "1", "23", "é", "ß", "!", "$$$", "日本", "　", "\x1c", "\x85", "aaaa", "😀", "½", "\r\n", " "]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(random.choice("abentiox") for _ in range(random.randint(0, 60))) for _ in range(1000)]
    texts += [r.text for r in table(spark, sf_dir, "documents").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = op2_bpe.decode(op2_bpe.encode(docs, PATH, P.PATTERN), PATH).collect()
    assert len(done) == len(texts)
    for r in done:
        assert r.ids == library.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded) == texts[r.doc_id].encode()


def test_bpe_tokens_are_reached(library):
    v = op2_bpe.vocabulary(PATH)
    words = random.Random(2).sample(sorted(v.ranks), 3000)
    starts = np.cumsum([0, *map(len, words)])[:-1]
    ids, off = op2_bpe.replay(np.frombuffer(b"".join(words), np.uint8), starts, v)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [[v.ranks[w]] for w in words]


def test_bpe_odd_rows(spark, odd_docs, no_docs, library):
    rows = op2_bpe.encode(odd_docs, PATH, P.PATTERN).collect()
    texts = [r.text or "" for r in odd_docs.collect()]
    assert sorted(map(str, (r.ids for r in rows))) == sorted(str(library.encode_ordinary(t)) for t in texts)
    assert op2_bpe.decode(op2_bpe.encode(no_docs, PATH, P.PATTERN), PATH).count() == 0


def _shingles(text):
    w = [x for x in re.split(r"[ \t-\r]+", text.lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(op3_fingerprint, "PIECE", 16)
    got = {r.doc_id: r for r in op3_fingerprint.op3_fingerprints(spark, sf_dir).collect()}
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    assert len(got) == len(docs)
    off = []
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        edited = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        off += [got[i].near_edited - _like(_shingles(t), _shingles(edited)), got[i].near_next - _like(_shingles(t), _shingles(after))]
    assert np.abs(off).mean() < 0.03 and np.abs(off).max() < 0.2


def test_fingerprint_merge(spark):
    words = [f"w{i}" for i in range(900)]
    a, b = " ".join(words[:600]), " ".join(words[300:])
    df = spark.createDataFrame([(a, b, " ".join(words))], "a string, b string, c string")
    for c in "abc":
        df = op3_fingerprint.with_sketch(df, c, f"s{c}")
    r = df.select(
        op3_fingerprint.resemblance(F.col("sa"), F.col("sc")).alias("r"), op3_fingerprint.containment(F.col("sa"), F.col("sc")).alias("k"),
        op3_fingerprint.distinct_shingles(op3_fingerprint.merged(F.col("sa"), F.col("sb"))).alias("n")).first()
    assert abs(r.r - 596 / 896) < 0.15 and r.k > 0.8 and 600 < r.n < 1250


def test_fingerprint_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = op3_fingerprint.with_next(op3_fingerprint.with_sketch(rows, "text", "sketch"), ["text", "sketch"])
    assert out.count() == odd_docs.count() and out.where("next_text is null").count() == 0
    same = out.where("doc_id in (8, 9)").select(op3_fingerprint.as_text(F.col("sketch")).alias("f")).distinct().count()
    assert same == 1
    none = op3_fingerprint.with_sketch(no_docs.select("doc_id", "text"), "text", "sketch")
    assert op3_fingerprint.with_next(none, ["text", "sketch"]).count() == 0


def test_html(spark, sf_dir, monkeypatch):
    import html

    got = {r.page_id: r for r in op4_html.op4_html_text(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "pages").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        text = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text)


PAGE = """<html><head><title>x</title></head><body><header><a href=/>Site</a> name</header><nav>Home <a>about</a></nav>
<aside class="sidebar">side text</aside><div id="content"><{0}><h1>T &lt;x&gt;</h1><p>One two  three &amp; four.<p>Five <b>six</b> seven
<div class="advert">Buy now</div><ul><li>item one<li><a href=x>item two</a></ul><form><label>Mail</label><input></form><p>Last para.</{1}>
<section class="comments"><p>I like it</p></section></div><div class="cookie-notice">We use cookies</div><script>var a="</p>";</script><footer>c 2020</footer>"""


def test_html_furniture():
    text = "T <x>\nOne two three & four.\nFive six seven\nitem one\nitem two\nLast para."
    assert op4_html.extract(PAGE.format("article", "article"), {}) == text
    assert op4_html.extract(PAGE.format('div class="x1"', "div"), {}) == text
    for page, want in ((None, ""), ("", ""), ("plain  words", "plain words"), ("<p>open <b>bold", "open bold"), ("<a", ""), ("<!-- x", ""), ("a &lt;b", "a <b")):
        assert op4_html.extract(page, {}) == want


def test_html_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (None, "<p>words here", "y"), (1, None, "x")], "page_id long, html string, kind string")
    assert sorted(r.text for r in op4_html.main_text(pages, op4_html.learn(pages)).collect()) == ["", "", "words here"]
    assert op4_html.main_text(pages.limit(0), {}).count() == 0


def test_chat_escapes(spark):
    texts = ["<|im_end|>", "<\\|x", "<\\\\|", "[INST] <<SYS>> </s> <s>", "[\\INST]", "plain < [ |", "", None, "<<s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", op5_chat.escape(F.col("t")).alias("e")).withColumn("b", op5_chat.unescape(F.col("e"))).collect()
    assert all(r.b == r.t for r in rows) and not any("<|" in (r.e or "") or "[INST]" in (r.e or "") for r in rows)


def test_chat_events(spark):
    log = [
        (1, 1, 0, 0, "message", "user", "hi"), (1, 2, 1, 1, "message", "assistant", ""), (1, 2, 1, 2, "delta", "assistant", "he"),
        (1, 2, 1, 3, "delta", "assistant", "llo"), (1, 3, 2, 4, "message", "user", "more"), (1, 2, 1, 5, "regenerate", "assistant", None),
        (1, 2, 1, 6, "delta", "assistant", "hey"), (1, 1, 0, 7, "edit", "user", "hi!"), (1, 4, 2, 8, "message", "user", "again")]
    events = spark.createDataFrame(log, "conv_id long, message long, turn long, seq long, kind string, role string, text string")
    got = sorted((r.turn, r.role, r.text) for r in op5_chat.fold(events).collect())
    assert got == [(0, "user", "hi!"), (1, "assistant", "hey"), (2, "user", "again")]
    r = op5_chat.render(op5_chat.fold(events)).first()
    assert [r.formatted[s.start:s.start + s.size] for s in r.loss] == ["hey"]


def test_chat_odd_rows(spark):
    rows = spark.createDataFrame([(None, 0, "user", "a"), (5, None, None, None), (5, 1, "assistant", "b"), (5, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in op5_chat.render(op5_chat.fold(op5_chat.events_of(rows))).collect()}
    assert len(got) == 2 and len(got[5].loss) == 2 and got[5].formatted.count("<|im_start|>") == 3
    assert op5_chat.render(op5_chat.fold(op5_chat.events_of(rows.limit(0)))).count() == 0


def test_language(spark, odd_docs, no_docs):
    rows = op7_langid.op7_language_id(spark, "/root/testdata/sf0.01").join(
        table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    profiles = op7_langid.train(odd_docs)
    got = op7_langid.identify(odd_docs, profiles).collect()
    assert len(got) == odd_docs.count() and all(r.lang_pred == "und" and r.score == 0 for r in got if not any(c.isalpha() for c in r.text or ""))
    assert all(0 <= r.score <= 1 for r in got)
    assert op7_langid.identify(no_docs, op7_langid.train(no_docs)).count() == 0
    assert {r.lang_pred for r in op7_langid.identify(odd_docs, op7_langid.train(no_docs)).collect()} == {"und"}


def test_toxicity(spark, odd_docs, no_docs):
    rows = op9_toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(
        table(spark, "/root/testdata/sf0.1", "labels").select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) > 0.92 * len(rows)
    assert sum(r.predicted for r in rows if r.toxic) > 0.6 * sum(r.toxic for r in rows)
    labels = spark.createDataFrame([(0, 1), (4, 0), (1, 1), (None, 0), (6, None)], "doc_id long, toxic int")
    model = op9_toxicity.train(odd_docs, labels)
    got = op9_toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert op9_toxicity.score(no_docs, op9_toxicity.train(no_docs, labels.limit(0))).count() == 0
