"""Calls made once, downloads committed as a whole, links as a browser reads them, prompts."""

import pytest
from pyspark.sql import functions as F

from sheaf.operators import providers
from sheaf.sources import documents as S
from sheaf.sources import files, ledger, services


def counting(folder):
    def call(text):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(text)
        if text.startswith("bad"):
            raise OSError(text)
        return f"re: {text}"

    return call


def made(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def test_a_second_run_makes_no_call(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    path, call = str(tmp_path / "ledger"), counting(str(tmp_path / "calls"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad")], "id long, request string").repartition(3)
    want = {1: "re: a", 2: "re: b", 3: "re: a", 4: None, 5: None}
    assert {r.id: r.reply for r in ledger.replies(rows, path, call, retries=1).collect()} == want
    assert made(tmp_path / "calls") == ["a", "b", "bad", "bad"]
    assert {r.id: r.reply for r in ledger.replies(rows.where("id < 5"), path, call).collect()} == {k: want[k] for k in range(1, 5)}
    assert len(made(tmp_path / "calls")) == 4
    assert {r.id: r.reply for r in ledger.replies(rows, path, lambda t: "later", retries=0).collect()} == want | {5: "later"}


def test_a_run_that_dies_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    (tmp_path / "calls").mkdir()
    path, call = str(tmp_path / "ledger"), counting(str(tmp_path / "calls"))
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(40)], "id long, request string")
    commits = []

    def second_fails(*a, real=files.commit_version):
        commits.append(1)
        if len(commits) == 2:
            raise RuntimeError("gone")
        return real(*a)

    with monkeypatch.context() as m:
        m.setattr(files, "commit_version", second_fails)
        with pytest.raises(RuntimeError, match="gone"):
            ledger.replies(rows, path, call, round_size=10)
    kept = ledger.known(spark, path).count()
    before = len(made(tmp_path / "calls"))
    assert 0 < kept < 40
    assert ledger.replies(rows, path, call).where("reply IS NOT NULL").count() == 40
    assert len(made(tmp_path / "calls")) == before + 40 - kept


def test_equal_keys_are_asked_once(spark, tmp_path):
    count = counting(str(tmp_path))

    def fetch(key):
        count(str(key["place"]))
        return {"x": 1.0}

    keys = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "place string").repartition(2)
    assert services.readings(keys, "x double", {"x": 0.0}, fetch).count() == 4
    assert made(tmp_path) == ["None", "a", "b"]
    assert services.request_of("place", {"location": "Salem town"}) == "https://nominatim.openstreetmap.org/search?format=json&limit=1&q=Salem+town%2C+India"
    assert "start=20240502&end=20240601" in services.request_of("satellite", {"latitude": 1, "longitude": 2}, "2024-06-01")


def test_a_failed_download_leaves_no_file(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "d")
    links = spark.createDataFrame([(1, "http://x/a.pdf", "a"), (2, "http://x/b", "b"), (3, "http://x/c", "c"), (4, "http://x/d", "a"), (5, None, "e")], "id long, link string, filename string")

    def fetch(link):
        if link.endswith("c"):
            raise OSError
        return ("text/html" if link.endswith("b") else "x"), b"data of " + link.encode()

    with monkeypatch.context() as m:
        m.setattr(files, "rename", lambda *_: False)
        with pytest.raises(files.Conflict):
            S.download(links, path, fetch)
    with pytest.raises(FileNotFoundError):
        S.keyed.read(spark, path)
    out = {r.id: r.ok for r in S.download(links, path, fetch).collect()}
    assert out == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert [(r.filename, bytes(r.content)) for r in S.downloaded(spark, path).collect()] == [("a", b"data of http://x/a.pdf")]
    docs = S.extract_documents(S.downloaded(spark, path), [S.plain_text])
    assert docs.first().pages[0].text == "data of http://x/a.pdf"


def test_links_as_a_browser_reads_them(spark):
    html = """<!-- <a href="/x.pdf">hidden</a> --><script>var a = '<a href="/s.pdf">script</a>'</script><a href=/y.pdf>Plain one</a>
<a title="a > b <!--" HREF = '/z.pdf?a=1&amp;b=2'>Tom &amp; Jerry &#233;&#x4e2D; &amp;lt; &unknown;</a><a data-href="/no.pdf">no address</a><a name=x>none</a><a href="/i.pdf"><!-- c --><i>Italic</i> text</a><style>a{}<a href="/t.pdf">styl</a></style>
<A class=k href="/w.pdf"
>Broken
line</A><!-- open <a href="/end.pdf">never closed</a>"""
    df = spark.createDataFrame([(1, "http://h.org/d/p", html), (2, "http://h.org", None), (3, "http://h.org", "&#0; &#55296; <a href='b.pdf'>&#38;lt; &#1114112;</a>")], "page_id long, url string, html string")
    assert [(r.page_id, r.idx, r.link, r.title) for r in S.links(df).orderBy("page_id", "idx").collect()] == [
        (1, 0, "http://h.org/y.pdf", "Plain one"), (1, 1, "http://h.org/z.pdf?a=1&b=2", "Tom & Jerry é中 &lt; &unknown;"), (1, 2, "http://h.org/i.pdf", "Italic text"), (1, 3, "http://h.org/w.pdf", "Broken\nline"),
        (3, 0, "http://h.org/b.pdf", "&lt; &#1114112;")]


def test_prompts_hold_passages_question_and_limit(spark):
    rows = spark.createDataFrame([("q", "why?", "FACTUAL", "fast", k, f"s{k}", f"text {k}") for k in (2, 1, 3)] + [("p", "how?", None, "slow", 1, None, None)],
                                 "query_id string, query string, query_type string, path string, chunk_rank int, source_file string, text string")
    got = {r.query_id: (r.prompt, r.max_tokens) for r in providers.prompts(rows, 2).collect()}
    assert got == {"q": ("PASSAGES\n(1) s1: text 1\n(2) s2: text 2\nKIND FACTUAL\nLIMIT 250 tokens\nQUESTION why?", 250), "p": ("PASSAGES\n(1) unknown: \nKIND OTHER\nLIMIT 700 tokens\nQUESTION how?", 700)}
    said = providers.answer_by_path(rows, providers.model_answer(lambda p: p.select("query_id", F.concat(F.lit("A"), F.col("max_tokens").cast("string")).alias("answer"))))
    assert {(r.query_id, r.answer) for r in said.collect()} == {("q", "A250"), ("p", "A700")}
