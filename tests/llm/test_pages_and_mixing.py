"""HTML extraction, mixing and the pipeline."""

import math
import random

import corpus_pipeline
from lathe.llm import decontaminate, html, mixing, simhash
from pyspark.sql import functions as F

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div><div class="content c12"><article id="a1"><h1>Title &amp; more</h1><p>First  <b>bold<br>line
<p>Second&nbsp;&eacute;&#x41;<ul><li>one<li>two</ul><form><input>Join</form><aside>Also</aside><!-- note --><table><tr><td>x<td>y</table></article>
<div id="comments"><p>Nice post, very long reader comment that goes on and on</div></div><div class="sidebar">Side</div><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more\nFirst bold line\nSecond éA\none\ntwo\nx\ny"


def test_extraction_leaves_page_chrome_out(spark):
    rows = [(1, "http://h.io/1", PAGE), (1, "http://h.io/1", PAGE), (2, "http://h.io/2", PAGE.replace("<article id", "<section><article id")), (3, None, PAGE), (4, "http://h.io/3", None), (5, "http://h.io/4", ""), (6, "http://q.io/5", "<p>plain < text & more<p>two"), (7, "http://h.io/6", "<body><div class='post'><p>" + "word " * 200_000 + "</div><nav>n"), (8, "x", "<div><!-- open"), (9, "x", "</p></div><script>a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = {r.page_id: r for r in html.page_text_report(df).collect()}
    assert html.page_text_report(df).count() == len(rows)
    for i in (1, 2, 3):
        assert got[i].text == TEXT and got[i].n_chars == len(TEXT)
    assert got[4].text == got[5].text == got[8].text == got[9].text == "" and got[4].n_chars == 0
    assert got[6].text == "plain < text & more\ntwo"
    assert got[7].text == ("word " * 200_000).strip()
    assert html.page_text_report(df.limit(0)).count() == 0


def test_attributes_are_read_by_name():
    page = '<body><div style="overflow:hidden" data-id="sidebar" title="comments"><p>kept</p><div role="complementary">gone</div><DIV CLASS=ads>gone</DIV></div>'
    assert html.extract(page, html.best_container(page)) == "kept"


def test_hosts_agree_on_one_path(spark):
    # one page whose comment block outweighs its article follows the path that its host voted for
    good = "<body><div class='story{}'><p>{}</p></div><div class='box'><p>{}</p></div></body>"
    rows = [(i, "http://a.io/x", good.format(i, "real text here " * 20, "short")) for i in range(5)] + [(9, "http://a.io/y", good.format(9, "real", "noise " * 50))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    winner = html.vote(df).collect()
    assert [(r.host, r.winner, r.votes) for r in winner] == [("a.io", "body>div.story#", 5)]
    assert {r.text for r in html.main_text(df).where("page_id = 9").collect()} == {"real"}
    shuffled = html.main_text(df, broadcast_bytes=-1).collect()
    assert {r.page_id: r.text for r in shuffled} == {r.page_id: r.text for r in html.main_text(df).collect()}


def test_raked_weights_meet_their_margins(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice("abc") if i % 3 else "a", rng.choice(["en", "de", None]), " ".join(["w"] * rng.randint(1, 50)) + rng.choice(["", " token", " license"])) for i in range(3000)]
    docs += [(None, "a", "en", "x y"), (5000, None, None, None), (5001, "b", "en", ""), (0, *docs[0][1:])]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").withColumn("weight", F.lit("old"))
    target = spark.createDataFrame([("a", 0.2), ("b", 0.3), ("c", 0.5)], "source string, target double")
    dims = mixing.document_dims()
    mixed = mixing.mix(df, dims, cycles=30, targets={"source": target}).cache()
    assert mixed.count() == len(docs)
    share = {r.source: r.s for r in mixed.groupBy("source").agg((F.sum(F.col("n_tokens") * F.col("weight")) / F.lit(mixed.agg(F.sum(F.col("n_tokens") * F.col("weight"))).first()[0])).alias("s")).collect()}
    assert all(math.isclose(share[k], v, abs_tol=1e-3) for k, v in {"a": 0.2, "b": 0.3, "c": 0.5}.items())
    tokens = mixed.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("copies")), F.sum(F.col("n_tokens") * F.col("expected"))).first()
    assert abs(tokens[1] - tokens[2]) < 0.1 * tokens[0]
    drawn = {r.sampled for r in mixed.where("doc_id = 0").collect()}
    assert len(drawn) == 1
    assert mixing.mix(df.limit(0), dims).count() == 0
    assert mixing.mix(df.where("text is null"), dims).first().weight == 1.0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st")]
    sentence = lambda k: " ".join(rng.choices(words, k=k)) + "."
    docs = [(i, "\n".join(sentence(12) for _ in range(6)), "en", f"s{i % 3}") for i in range(120)]
    docs = [(i, t + (" vexarus" if i % 6 == 0 else ""), g, s) for i, t, g, s in docs]
    item = " ".join(sentence(20).split())
    docs += [(200, docs[1][1], "en", "s1"), (201, sentence(30) + " " + item + " " + sentence(30), "en", "s2"), (202, None, None, None), (203, "", "en", "s0"), (204, sentence(30) + "\n" + docs[2][1].split("\n")[0].upper(), "en", "s1")]
    frame = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d[0], 0, int(d[0] % 6 == 0)) for d in docs[:120]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = {r.doc_id for r in now.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        before, now = ids, spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in now.collect()}
        assert ids <= before
        if name == "toxicity":
            assert before - ids == {i for i in range(120) if i % 6 == 0}
        if name == "line_dedup":
            assert before - ids == {200} and {r.text.count("\n") for r in now.where("doc_id = 204").collect()} == {0}
        if name == "near_dedup":
            assert before - ids == {203}  # null and empty text are one group
            assert simhash.near_duplicates(now).where("group_rows > 1").count() == 0
        if name == "decontamination":
            assert before - ids == {201}
            assert decontaminate.decontaminate(now, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).where("size(items) > 0").count() == 0
    assert now.count() == corpus_pipeline.run(spark, str(tmp_path)).count() > 0
