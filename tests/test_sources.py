import json

import pytest
from pyspark.sql import functions as F

from sheaf import schemas
from sheaf.sources import documents as S
from sheaf.sources import registry as reg


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    a = spark.createDataFrame([("c1", "f"), ("c2", "f")], "chunk_id string, source_file string")
    b = spark.createDataFrame([("c2", "g"), ("c3", "g")], "chunk_id string, source_file string")
    assert [S.append_chunks(x, path) for x in (a, b, b)] == [2, 1, 0]
    assert {(r.chunk_id, r.source_file) for r in spark.read.parquet(path).collect()} == {("c1", "f"), ("c2", "f"), ("c3", "g")}


def test_scan_and_extract_with_fallback(spark, tmp_path):
    for name, body in (("a.pdf", b"good"), ("B.PDF", b"bad"), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(body)
    files = S.scan_files(spark, str(tmp_path))
    assert {r.filename for r in files.select("filename").collect()} == {"a.pdf", "B.PDF"}

    def first(data):
        if data == b"bad":
            raise ValueError
        return [{"page_number": 1, "text": " "}, {"page_number": 2, "text": data.decode()}]

    def second(data):
        return [{"page_number": 1, "text": "from second", "tables_text": ["t"]}]

    docs = S.extract_documents(files, [first, second], ocr=lambda data, page: f"ocr {page}")
    out = {r.filename: [p.text for p in r.pages] for r in docs.collect()}
    assert out == {"a.pdf": ["ocr 1", "good"], "B.PDF": ["from second"]}
    S.write_extracted(docs, str(tmp_path / "json"))
    back = spark.read.schema(schemas.EXTRACTED).json(str(tmp_path / "json"))
    assert back.count() == 2 and S.new_files(files, back).count() == 0


def test_cleaning_stats(spark):
    pages = spark.createDataFrame([("f", 1, "a    b", ["x"]), ("f", 2, None, None)], "filename string, page_number int, text string, tables_text array<string>")
    r = S.cleaning_stats(S.clean_pages(pages)).first()
    assert (r.chars_before, r.chars_after, r.chars_removed, r.reduction_pct) == (6, 3, 3, 50.0)


def test_links(spark):
    html = '<a href="/x/a.pdf"> Long title </a><a class="k" href="b.PDF"></a><a href="http://o.org/c.pdf">abc</a><a href="d.html">Other page</a><a href="http://o.org/e.pdf"><b>Bold</b> one</a>'
    pages = spark.createDataFrame([(1, "https://h.org/dir/page?q=1", html), (2, None, None)], "page_id long, url string, html string")
    assert [(r.link, r.title) for r in S.links(pages).orderBy("idx").collect()] == [("https://h.org/x/a.pdf", "Long title"), ("https://h.org/dir/b.PDF", "Untitled"), ("http://o.org/e.pdf", "Bold one")]


def test_safe_filename_and_lines(spark):
    r = spark.createDataFrame([("Rice: pests & care/2024 ", "ICAR Portal", 3, "# T\n```\n# x\n```\n\n---\nend")], "t string, s string, i int, m string")
    out = r.select(S.safe_filename(F.col("t"), F.col("s"), F.col("i")), S.line_kinds(F.col("m")).alias("k")).first()
    assert out[0] == "ICAR_Rice__pests___care_2024_3.pdf" and [x.kind for x in out.k] == ["h1", "fence", "code", "fence", "blank", "rule", "paragraph"]


def test_registry(spark):
    log = spark.createDataFrame([("a", "failed", 1), ("a", "done", 2), ("b", "done", 1), ("b", "failed", 3)], "filename string, status string, processed_at int")
    assert {r.filename for r in reg.done(log).collect()} == {"a"}
    assert {r.status: r.n for r in reg.summary(log).collect()} == {"done": 1, "failed": 1}
    assert reg.reset(log, spark.createDataFrame([("a",)], "filename string")).count() == 2
    assert reg.next_id(spark.createDataFrame([("chunk_000041",)], "chunk_id string")) == 42


def test_export_inverts_flattening(spark):
    store = spark.createDataFrame([("c", "t", None, "f", None, None, "a , ,b")], "chunk_id string, text string, char_count int, source_file string, authority_score double, trust_weight double, crop_tags string")
    r = S.export_vectors(store).first()
    assert (r.char_count, r.authority_score, r.trust_weight, r.crop_tags) == (0, 0.5, 1.0, ["a", "b"])


def test_migration_refuses_an_existing_target(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"chunk_id": "c1", "text": "t"}]))
    S.migrate_json(spark, str(tmp_path / "c.json"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().chunk_id == "c1"
    with pytest.raises(Exception, match="(?i)exist"):
        S.migrate_json(spark, str(tmp_path / "c.json"), str(tmp_path / "out"))



def test_services_fall_back(spark):
    from sheaf.sources import services

    keys = spark.createDataFrame([("a",), ("b",)], "place string")

    def fetch(key):
        if key["place"] == "b":
            raise TimeoutError
        return {"soil_moisture": 0.2, "label": "OPTIMAL"}

    got = {r.place: (r.soil_moisture, r.label) for r in services.readings(keys, "soil_moisture double, label string", services.DEFAULT_SOIL, fetch).collect()}
    assert got["a"] == (0.2, "OPTIMAL") and got["b"][1] == "UNAVAILABLE"
    off = services.readings(keys, "stage string, confidence double", services.DEFAULT_SATELLITE).collect()
    assert {(r.stage, r.confidence) for r in off} == {(None, 0.0)}
    services.register(spark)
    assert spark.read.format("service").option("schema", "part int, i int").option("call", "tests.service_rows:rows_of").option("parts", 2).load().count() == 6


def test_index_is_rebuilt_when_stale(spark, tmp_path):
    from sheaf.sources import stores

    docs = spark.createDataFrame([(1, "red fox"), (2, "blue dog")], "chunk_id long, text string")
    assert stores.read_index(spark, str(tmp_path / "i")) is None
    assert stores.current_index(docs.limit(1), str(tmp_path / "i")).stats.first().n_docs == 1
    assert stores.current_index(docs, str(tmp_path / "i")).stats.first().n_docs == 2
    assert stores.SearchConfig.loads(stores.SearchConfig(top_k=7).dumps()).top_k == 7


def test_graph_build_resumes(spark, tmp_path):
    from sheaf.operators.providers import pattern_triplets
    from sheaf.sources import stores

    path = str(tmp_path / "g")
    chunks = spark.createDataFrame([("c1", "a.pdf", "rice is crop. water is wet"), ("c2", "a.pdf", "no facts here"), ("c3", "b.pdf", "sun is hot")], "chunk_id string, source_file string, text string")
    stores.build_graph(chunks.where("chunk_id <> 'c3'"), path, pattern_triplets)
    stores.build_graph(chunks, path, pattern_triplets)
    assert {(r.subject, r.object) for r in spark.read.parquet(f"{path}/edges").collect()} == {("rice", "crop"), ("water", "wet"), ("sun", "hot")}
    assert spark.read.parquet(f"{path}/processed").count() == 3
    stores.append_log(spark.createDataFrame([("q",)], "query string"), str(tmp_path / "log"))
    assert stores.read_table(spark, str(tmp_path / "log"), "query string, ts timestamp").count() == 1
    assert stores.read_table(spark, str(tmp_path / "none"), "query string").count() == 0
