import http.server
import json
import threading
import zipfile

from metaweave.sources import files as S


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return f"file://{p}"


def test_edges(spark, tmp_path):
    p = put(tmp_path, "e.tsv", "n1\tn2\tw\nb\ta\t2.5\nc\td\tx\n")
    assert [tuple(r) for r in S.edges(spark, p, weighted=True, undirected=True).collect()] == [("a", "b", 2.5), ("c", "d", 1.0)]


def test_gmt(spark, tmp_path):
    p = put(tmp_path, "g.gmt", "set1\tid1\ta\tb\nset2\tid2\n")
    assert [tuple(r) for r in S.gmt(spark, p).collect()] == [("set1", "id1", "a"), ("set1", "id1", "b")]


def test_obo(spark, tmp_path):
    p = put(tmp_path, "o.obo", "format-version: 1.2\n\n[Term]\nid: X:1\nname: one\n\n[Term]\nid: X:2\nname: two\nis_a: X:1 {src=q} ! one\nrelationship: part_of X:3 ! three\nalt_id: X:9\n\n[Term]\nid: X:4\nis_obsolete: true\nis_a: X:1\n\n[Typedef]\nid: part_of\n")
    t = S.obo(spark, p)
    assert sorted(r.id for r in t.collect()) == ["X:1", "X:2"]
    assert sorted(tuple(r) for r in S.hierarchy(t).collect()) == [("X:2", "X:1")]
    assert sorted(tuple(r) for r in S.hierarchy(t, ("part_of",)).collect()) == [("X:2", "X:1"), ("X:2", "X:3")]


def test_cell_lines_levels_and_signed_edges(spark, tmp_path):
    p = put(tmp_path, "c.txt", "ID   K562\nAC   CVCL_1\nSY   K-562; K 562\nHI   CVCL_2 ! Parent\n//\nID   HeLa\nAC   CVCL_3\n//\n")
    assert sorted((r.id, r.synonyms, r.parents) for r in S.cell_lines(spark, p).collect()) == [("CVCL_1", ["K-562", "K 562"], ["CVCL_2"]), ("CVCL_3", [], [])]
    p = put(tmp_path, "k.keg", "A x\nE A01AA01 name\nF D001 drug\nF D002 drug\nE B01 other\nF D003 z\n")
    assert [tuple(r) for r in S.levels(spark, p, "E", "F").collect()] == [("A01AA01 name", "D001 drug"), ("A01AA01 name", "D002 drug"), ("B01 other", "D003 z")]
    p = put(tmp_path, "h.txt", "source\tsource_desc\tsource_id\ttarget\ttarget_desc\ttarget_id\tweight\nA\tB\tC\tD\tE\tF\tG\ng1\tna\t17\tc1\tna\tna\t-1.0\n")
    assert [tuple(r) for r in S.signed_edges(spark, p).collect()] == [("g1||17", "c1", -1.0)]


def test_preamble_by_count(spark, tmp_path):
    body = "".join(f"{i},x{i}\n" for i in range(5000))
    put(tmp_path, "a.csv", "# made by\n# hand\nid,name\n" + body)
    p = put(tmp_path, "b.csv", "first\nsecond\nid,name\n7,\"q,r\"\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted(tuple(r) for r in S.table(spark, p[: -len("b.csv")] + "*.csv", "id int, name string", skip_lines=2).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([(i, f"x{i}") for i in range(5000)] + [(7, "q,r")])


def test_excel(spark, tmp_path):
    sheet = lambda rows: f'<worksheet xmlns="m"><sheetData>{rows}</sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="q"><sheets><sheet name="One" r:id="rId1"/><sheet name="Two" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>gene</t></si><si><r><t>TP</t></r><r><t>53</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet('<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="AB3"><v>2.5</v></c></row><row r="4"><c r="A4" t="inlineStr"><is><t>x y</t></is></c></row>'))
        z.writestr("xl/worksheets/sheet2.xml", sheet('<row><c><v>1</v></c></row><row><c><v>2</v></c></row>'))
    p = f"file://{tmp_path}/w.xlsx"
    assert [tuple(r) for r in S.excel(spark, p, "gene string, w double", skip_rows=2, columns=[0, 27]).collect()] == [("TP53", 2.5), ("x y", None)]
    assert [tuple(r) for r in S.excel(spark, p, "n int", sheet="Two", skip_rows=0).collect()] == [(1,), (2,)]


def test_pages(spark):
    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rsplit("=", 1)[1])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"results": [{"id": page * 10 + i, "name": "n"} for i in range(page)]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/x?page={{page}}"
        got = sorted(tuple(r) for r in S.pages(spark, url, range(4), "id long, name string", "results").collect())
    finally:
        server.shutdown()
    assert got == [(10, "n"), (20, "n"), (21, "n"), (30, "n"), (31, "n"), (32, "n")]


def test_json_xml_and_mappings(spark, tmp_path):
    p = put(tmp_path, "j.json", '{"a": 1}\n{"a": null, "b": "x"}\n')
    assert [tuple(r) for r in S.json_lines(spark, p, "a int, b string").collect()] == [(1, None), (None, "x")]
    p = put(tmp_path, "x.xml", "<all><t><id>1</id></t><t><id>2</id></t></all>")
    assert [r.id for r in S.xml(spark, p, "t", "id int").collect()] == [1, 2]
    p = put(tmp_path, "m.tsv", "id\tname\told\nA\tx\tp|q\nB\t\tr\nA\tx\tp\n")
    assert sorted(tuple(r) for r in S.mapping(spark, p, 2, 0, 3, within="|").collect()) == [("p", "A"), ("q", "A"), ("r", "B")]
    assert sorted(tuple(r) for r in S.mapping(spark, p, 1, 0, 3).collect()) == [("x", "A")]


def test_dense_matrix_and_vectors(spark, tmp_path):
    m = spark.createDataFrame([(0, [0.0, 2.0, 1.0]), (1, [2.0, 0.0, 0.0]), (2, [1.0, 0.0, 3.0])], "r long, v array<double>")
    assert sorted(tuple(r) for r in S.dense_cells(m, True).collect()) == [(0, 1, 2.0), (0, 2, 1.0), (2, 2, 3.0)]
    assert S.dense_cells(m).count() == 5
    p = f"file://{tmp_path}/v"
    spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "nd string, v array<double>").write.parquet(p)
    assert S.embedding(spark, p).count() == 2
    assert [tuple(r) for r in S.embedding(spark, p, spark.createDataFrame([("b",), ("c",), ("b",)], "nd string")).collect()] == [("b", [2.0])]


def test_sinks_read_back(spark, tmp_path):
    root = f"file://{tmp_path}"
    nodes = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 3, 1)], "nd string, id long, component long")
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 1.0)], "n1 string, n2 string, w double")
    S.write_network(nodes, edges, f"{root}/net")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{root}/net/edges").collect()) == [(1, 2, 0.5), (2, 3, 1.0)]
    assert sorted(tuple(r) for r in S.read_network(spark, f"{root}/net").collect()) == [("a", "b", 0.5), ("b", "c", 1.0)]
    assert sorted(tuple(r) for r in S.node_components(spark, f"{root}/net").collect()) == [("a", 1), ("b", 1), ("c", 1)]
    S.write_walks(spark.createDataFrame([(["a", "b", "a"],), (["c"],)], "walk array<string>"), f"{root}/walks")
    assert sorted((r.start, r.walk) for r in S.read_walks(spark, f"{root}/walks").collect()) == [("a", ["a", "b", "a"]), ("c", ["c"])]
    S.write_stats(spark.createDataFrame([("nodes", 3.0), ("edges", 2.0)], "name string, value double"), f"{root}/stats")
    assert [tuple(r) for r in spark.read.csv(f"{root}/stats", sep="\t", header=True).collect()] == [("edges", "2.0"), ("nodes", "3.0")]
    S.write_text_edges(edges.orderBy("w", ascending=False), f"{root}/text")
    assert [tuple(r) for r in S.edges(spark, f"{root}/text", weighted=True).collect()] == [("a", "b", 0.5), ("b", "c", 1.0)]


def test_prefixes(spark):
    df = spark.createDataFrame([("A01AA01",), ("B01",)], "code string").select(S.prefixes("code").alias("p"))
    assert [r.p for r in df.collect()] == [["A", "A01", "A01A", "A01AA", "A01AA01"], ["B", "B01"]]


def test_stream_of_edges(spark, tmp_path):
    from metaweave.streaming import edges as X

    d = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    q = X.append(X.edges(stream, "user_id", "event_type", "ts", "400 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type").distinct().count()
    assert got.count() == want == got.select("n1", "n2").distinct().count()
