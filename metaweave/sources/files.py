"""Readers of the formats that edge lists, ontologies and measurements come in, and Parquet and text sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edges(spark: SparkSession, path: str, sep: str = "\t", header: bool = True, weighted: bool = False, undirected: bool = False) -> DataFrame:
    """n1, n2[, w] of a text edge list; an undirected pair has the lesser id first; a weight that is no number is 1."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("n1", "n2", "w")[: 3 if weighted else 2]])
    e = spark.read.csv(path, sep=sep, header=header, schema=schema, enforceSchema=True)
    e = e.withColumn("w", F.coalesce(F.expr("try_cast(w AS double)"), F.lit(1.0))) if weighted else e
    return e.withColumns({"n1": F.least("n1", "n2"), "n2": F.greatest("n1", "n2")}) if undirected else e


def table(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, encoding: str = "UTF-8", skip_prefix: str | None = None, skip_lines: int = 0) -> DataFrame:
    """Delimited text with an explicit schema; lines that start with skip_prefix (one character) or are the first skip_lines of a file are a preamble.

    With skip_lines, a record is one line: a quoted cell holds no line break.
    """
    if not skip_lines:
        return spark.read.csv(path, sep=sep, header=header, schema=schema, encoding=encoding, comment=skip_prefix)
    rows = after_lines(spark, path, skip_lines + header).filter("trim(value) <> ''")
    rows = rows.filter(~F.col("value").startswith(skip_prefix)) if skip_prefix else rows
    return rows.select(F.from_csv("value", schema, {"sep": sep}).alias("x")).select("x.*")


def after_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """value: the lines of each file but its first n, which all lie in the split that starts at byte 0."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for batch in batches:
            keep = pd.Series(True, index=batch.index)
            for file, rows in batch[batch["start"] == 0].groupby("file"):
                gone = min(len(rows), n - seen.get(file, 0))
                keep[rows.index[:gone]] = False
                seen[file] = seen.get(file, 0) + gone
            yield batch.loc[keep, ["value"]]

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return lines.mapInPandas(cut, "value string")


def excel(spark: SparkSession, path: str, schema: str, sheet: str | int = 0, skip_rows: int = 1, columns: Sequence[int] | None = None) -> DataFrame:
    """Rows of a sheet (by name or place) of xlsx workbooks below skip_rows, the columns by place; each workbook is one task's, as a sheet holds 2**20 rows at most."""
    fields = spark.createDataFrame([], schema).schema.fields
    places = list(columns) if columns is not None else list(range(len(fields)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = list(workbook_rows(content, sheet))[skip_rows:]
                if rows:
                    yield pd.DataFrame({f"c{i}": [r.get(p) for r in rows] for i, p in enumerate(places)}, dtype=object)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, ", ".join(f"c{i} string" for i in range(len(places))))
    return raw.select(*[F.expr(f"try_cast(c{i} AS {f.dataType.simpleString()})").alias(f.name) for i, f in enumerate(fields)])


def workbook_rows(content: bytes, sheet: str | int) -> Iterator[dict[int, str]]:
    """Each row's texts by column place; shared and inline strings resolved; a row that the sheet leaves out is empty."""
    import io
    import zipfile
    from xml.etree import ElementTree

    name = lambda x: x.tag.rsplit("}", 1)[-1]
    text = lambda x: "".join(t.text or "" for t in x.iter() if name(t) == "t")
    book = zipfile.ZipFile(io.BytesIO(content))
    tree = lambda member: ElementTree.fromstring(book.read(member))
    shared = [text(x) for x in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in book.namelist() else []
    sheets = [x.attrib for x in tree("xl/workbook.xml").iter() if name(x) == "sheet"]
    chosen = sheets[sheet] if isinstance(sheet, int) else next(x for x in sheets if x["name"] == sheet)
    link = next(v for k, v in chosen.items() if k.endswith("}id"))
    target = next(x.attrib["Target"] for x in tree("xl/_rels/workbook.xml.rels") if x.attrib["Id"] == link)
    done = 0
    for row in (x for x in tree(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter() if name(x) == "row"):
        number = int(row.attrib.get("r", done + 1))
        yield from ({} for _ in range(number - done - 1))
        done, out = number, {}
        for place, cell in enumerate(row):
            if letters := cell.attrib.get("r", "").rstrip("0123456789"):
                place = 0
                for letter in letters:
                    place = place * 26 + ord(letter) - 64
                place -= 1
            kind, value = cell.attrib.get("t"), next((x.text for x in cell if name(x) == "v"), None)
            got = text(cell) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value is not None else value
            if got is not None:
                out[place] = got
        yield out


def pages(spark: SparkSession, url: str, numbers: Sequence[int], schema: str, field: str, tries: int = 3) -> DataFrame:
    """Records of a paged JSON service: url holds {page}; each page is fetched by a task, and field lists its records."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        import urllib.request

        for batch in batches:
            for page in batch["page"]:
                for left in reversed(range(tries)):
                    try:
                        with urllib.request.urlopen(url.format(page=page), timeout=60) as r:
                            yield pd.DataFrame({"body": [r.read().decode()]})
                        break
                    except OSError:
                        if not left:
                            raise
                        time.sleep(1)

    asked = spark.createDataFrame([(int(n),) for n in numbers], "page long").repartition(max(1, len(numbers)))
    body = asked.mapInPandas(fetch, "body string").select(F.from_json("body", f"`{field}` array<struct<{schema}>>").alias("x"))
    return body.select(F.inline(F.col(f"x.`{field}`")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def mapping(spark: SparkSession, path: str, source: int, target: int, columns: int, sep: str = "\t", header: bool = True, within: str | None = None) -> DataFrame:
    """src, dst of two columns (by place) of a mapping file; a cell that lists several values by the separator within counts as so many rows; empty cells go."""
    raw = spark.read.csv(path, sep=sep, header=header, schema=", ".join(f"c{i} string" for i in range(columns)), enforceSchema=True)
    for c in {source, target} if within else ():
        raw = raw.withColumn(f"c{c}", F.explode(F.split(f"c{c}", "\\Q" + within + "\\E")))
    pair = raw.select(F.trim(f"c{source}").alias("src"), F.trim(f"c{target}").alias("dst"))
    return pair.filter("src <> '' AND dst <> ''").distinct()


def dense_cells(m: DataFrame, undirected: bool = False) -> DataFrame:
    """r, c, w: the non-zero cells of a matrix given as rows (r, v), places from 0; of an undirected one the upper triangle."""
    cells = m.select("r", F.posexplode("v").alias("c", "w")).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "w").filter("w <> 0")
    return cells.filter("r <= c") if undirected else cells


def embedding(spark: SparkSession, path: str, universe: DataFrame | None = None) -> DataFrame:
    """nd, v of a folder of vectors, of the nodes of a universe only where one is given."""
    e = spark.read.parquet(path).select("nd", "v")
    return e.join(universe.select("nd").distinct(), "nd", "left_semi") if universe is not None else e


def node_components(spark: SparkSession, path: str) -> DataFrame:
    """nd, component of a network written by write_network."""
    return spark.read.parquet(f"{path}/nodes").select("nd", "component")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query run by the database, joins and predicates included."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def gmt(spark: SparkSession, path: str) -> DataFrame:
    """name, id, member of ragged gene-set lines."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).filter(F.size("p") > 2)
    return parts.select(F.col("p")[0].alias("name"), F.col("p")[1].alias("id"), F.explode(F.slice("p", F.lit(3), F.size("p"))).alias("member")).filter("member <> ''")


def stanzas(spark: SparkSession, path: str, end: str) -> DataFrame:
    """lines of each record of a flat file whose records end with a separator."""
    return spark.read.text(path, lineSep=end).select(F.split("value", "\n").alias("lines"))


def values(lines: Column, tag: str) -> Column:
    """What stands behind a tag on the lines that start with it."""
    return F.transform(F.filter(lines, lambda x: x.startswith(tag)), lambda x: F.trim(F.substring(x, F.lit(len(tag) + 1), F.length(x))))


def obo(spark: SparkSession, path: str) -> DataFrame:
    """id, name, namespace, is_a, relationship, alt_id, xref, replaced_by of the terms that are not obsolete."""
    s = stanzas(spark, path, "\n\n").filter(F.array_contains("lines", "[Term]"))
    first = lambda tag: F.element_at(values(F.col("lines"), tag), 1)
    bare = lambda tag: F.transform(values(F.col("lines"), tag), lambda x: F.trim(F.split(x, r" [!{]")[0]))
    gone = F.size(F.filter("lines", lambda x: x.startswith("is_obsolete: true"))) > 0
    get = lambda tag: F.when(F.size(values(F.col("lines"), tag)) > 0, first(tag))
    return s.filter(~gone).select(get("id:").alias("id"), get("name:").alias("name"), get("namespace:").alias("namespace"), bare("is_a:").alias("is_a"), bare("relationship:").alias("relationship"), bare("alt_id:").alias("alt_id"), bare("xref:").alias("xref"), get("replaced_by:").alias("replaced_by"))


def hierarchy(terms: DataFrame, relations: tuple[str, ...] = ()) -> DataFrame:
    """child, parent by is_a and the named relationships."""
    up = terms.select(F.col("id").alias("child"), F.explode("is_a").alias("parent"))
    rel = terms.select(F.col("id").alias("child"), F.explode("relationship").alias("r")).select("child", F.split("r", " ").alias("r"))
    more = rel.filter(F.col("r")[0].isin(list(relations))).select("child", F.col("r")[1].alias("parent"))
    return up.unionByName(more).distinct()


def cell_lines(spark: SparkSession, path: str) -> DataFrame:
    """name, id, synonyms, parents of a two-letter-tag flat file with // between records."""
    s = stanzas(spark, path, "//\n")
    get = lambda tag: F.element_at(values(F.col("lines"), tag), 1)
    s = s.filter(F.size(values(F.col("lines"), "AC   ")) > 0)
    syn = F.coalesce(F.when(F.size(values(F.col("lines"), "SY   ")) > 0, F.split(get("SY   "), "; ")), F.array().cast("array<string>"))
    return s.select(get("ID   ").alias("name"), get("AC   ").alias("id"), syn.alias("synonyms"), F.transform(values(F.col("lines"), "HI   "), lambda x: F.split(x, " ! ")[0]).alias("parents"))


def signed_edges(spark: SparkSession, path: str) -> DataFrame:
    """Seven columns below two header lines: source and target (ids joined by double pipes) and weight."""
    names = ("source", "source_desc", "source_id", "target", "target_desc", "target_id", "weight")
    raw = spark.read.csv(path, sep="\t", header=False, schema=", ".join(f"{n} string" for n in names))
    d = raw.withColumn("weight", F.expr("try_cast(weight AS double)")).filter("weight IS NOT NULL")
    key = lambda k: F.concat_ws("||", *[F.when(F.col(c) != "na", F.col(c)) for c in (k, f"{k}_desc", f"{k}_id")])
    return d.select(key("source").alias("n1"), key("target").alias("n2"), "weight")


def levels(spark: SparkSession, path: str, group: str, leaf: str) -> DataFrame:
    """group value, leaf value of a file whose lines start with a level letter: each leaf line belongs to the last group line.

    Lines are numbered within the file; such classification files are small by nature and read as one split."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "x"))
    from metaweave.operators.edges import carried_forward

    head = F.when(F.col("x").startswith(group), F.trim(F.substring("x", 2, 1 << 20)))
    t = t.withColumn("one", F.lit(1)).withColumn("g", head)
    t = t.withColumn("g", carried_forward(t, "one", F.col("g")))
    return t.filter(F.col("x").startswith(leaf)).select(F.col("g").alias("parent"), F.trim(F.substring("x", 2, 1 << 20)).alias("child"))


def prefixes(code: Column, lengths: tuple[int, ...] = (1, 3, 4, 5, 7)) -> Column:
    """A classification code's prefixes, the code itself last."""
    return F.array_distinct(F.array(*[F.substring(code, 1, n) for n in lengths]))


def write_edges(e: DataFrame, path: str) -> None:
    """Parquet by edge type and dataset."""
    e.write.mode("overwrite").partitionBy("metaedge", "dataset").parquet(path)


def write_text_edges(e: DataFrame, path: str) -> None:
    e.orderBy("n1", "n2").write.mode("overwrite").csv(path, sep="\t", header=True)


def write_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A network's nodes (id, component, nd) and its edges (n1, n2, further columns) with ids for labels."""
    nodes.select("id", "component", "nd").write.mode("overwrite").parquet(f"{path}/nodes")
    _relabelled(edges, nodes, "nd", "id").write.mode("overwrite").parquet(f"{path}/edges")


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """The edges of a written network, with their labels again."""
    return _relabelled(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes"), "id", "nd")


def _relabelled(e: DataFrame, nodes: DataFrame, old: str, new: str) -> DataFrame:
    columns = e.columns
    for side in ("n1", "n2"):
        e = e.join(nodes.select(F.col(old).alias(side), F.col(new).alias("__new")), side).withColumn(side, F.col("__new")).drop("__new")
    return e.select(columns)


def write_walks(walks: DataFrame, path: str) -> None:
    """Gzipped text, a walk a line."""
    walks.select(F.array_join("walk", " ").alias("value")).write.mode("overwrite").text(path, compression="gzip")


def read_walks(spark: SparkSession, path: str) -> DataFrame:
    """start, walk."""
    return spark.read.text(path).select(F.split("value", " ").alias("walk")).select(F.col("walk")[0].alias("start"), "walk")


def write_stats(stats: DataFrame, path: str) -> None:
    """name, value as one text file of lines: a statistics table has few rows."""
    stats.select("name", F.col("value").cast("string")).coalesce(1).sortWithinPartitions("name").write.mode("overwrite").csv(path, sep="\t", header=True)
