"""Statements and logs as files: N-Triples text, expanded JSON-LD, JSON lines, CSV, pages; and the sinks for them.

All paths are read and written by Spark alone, so any store that Spark reaches will do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.storage import saved

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: A literal ends at the last quote that its datatype, language, graph (N-Quads) or the final dot follow; quotes inside are escaped.
TRIPLE = r'^\s*(?:<([^>]*)>|_:(\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|_:(\S+)|"([^\n]*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)(?:\s+(?:<[^>]*>|_:\S+))?\s*\.\s*$'


def escaped(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def told(head: Column, mark: str):
    """A step that puts the character of a code point (hex) in the place of its escape; a backslash so made escapes nothing."""
    char = lambda code: F.replace(F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"), F.lit("\\"), F.lit(mark))
    return lambda text, code: F.replace(text, F.concat(head, code), char(code))


def unescaped(text: Column) -> Column:
    mark = "\x00"  # stands for an escaped backslash while the others are read
    text = F.replace(text, F.lit("\\\\"), F.lit(mark))
    for a, b in (('"', '\\"'), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(b), F.lit(a))
    for sign, digits in (("u", 4), ("U", 8)):
        codes = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\\{sign}([0-9A-Fa-f]{{{digits}}})"), F.lit(1)))
        head = F.lit(f"\\{sign}")
        text = F.when(F.contains(text, head), F.aggregate(codes, text, told(head, mark))).otherwise(text)
    return F.replace(text, F.lit(mark), F.lit("\\"))


def as_lines(graph: DataFrame) -> DataFrame:
    """Statements as N-Triples lines; text, datatype and language are kept exactly."""
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("dt").isNotNull(), F.concat(F.lit("^^<"), "dt", F.lit(">"))).otherwise(F.lit(""))
    literal = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), tail)
    return graph.select(F.concat_ws(" ", node("s"), F.concat(F.lit("<"), "p", F.lit(">")), F.when(F.col("o_kind") == "literal", literal).otherwise(node("o")), F.lit(".")).alias("value"))


def write_statements(graph: DataFrame, path: str) -> None:
    as_lines(graph).write.text(path)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, o_kind, dt, lang of N-Triples lines; blank lines and comments are passed over, damaged ones an error."""
    lines = spark.read.text(path).where((F.btrim("value") != "") & ~F.col("value").rlike("^\\s*#"))
    part = lambda i: F.regexp_extract("value", TRIPLE, i)
    some = lambda c: F.when(c != "", c)
    node = lambda iri, blank: F.when(part(iri) != "", part(iri)).when(part(blank) != "", F.concat(F.lit("_:"), part(blank)))
    good = F.when(F.col("value").rlike(TRIPLE), True).otherwise(F.raise_error(F.concat(F.lit("no statement: "), "value")).cast("boolean"))
    kind = F.when(part(4) != "", "iri").when(part(5) != "", "bnode").otherwise("literal")
    literal = unescaped(part(6))
    dt = F.when(kind == "literal", F.coalesce(some(part(7)), F.when(part(8) != "", "rdf:langString")))
    return lines.where(good).select(node(1, 2).alias("s"), part(3).alias("p"), F.coalesce(node(4, 5), literal).alias("o"), kind.alias("o_kind"), dt.alias("dt"), some(part(8)).alias("lang"))


def write_json_ld(graph: DataFrame, path: str) -> None:
    """Expanded JSON-LD, a node object a line: "@id" and, for each property, a list of "@id" or of "@value" with "@type" or "@language"."""
    literal = F.col("o_kind") == "literal"
    value = F.struct(
        F.when(~literal, F.col("o")).alias("@id"), F.when(literal, F.col("o")).alias("@value"), F.when(literal & F.col("lang").isNull(), F.col("dt")).alias("@type"), F.when(literal, F.col("lang")).alias("@language")
    )
    lists = graph.groupBy("s", "p").agg(F.collect_list(value).alias("values"))
    nodes = lists.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("p", "values"))).alias("of"))
    nodes.select(F.concat(F.regexp_replace(F.to_json(F.struct(F.col("s").alias("@id"))), "[}]$", ""), F.lit(","), F.expr("substr(to_json(of), 2)")).alias("value")).write.text(path)


def read_json_ld(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """s, p, o, o_kind, dt, lang of expanded, flat JSON-LD: a node object or a list of them a line, or (lines=False) a file; "@graph" is opened.

    "@type" is a statement of rdf:type; a node without "@id" is a blank one; true, false and numbers have their XSD types.
    Lists, nested nodes, contexts that shorten names and damaged text are errors.
    """
    texts = spark.read.text(path, wholetext=not lines).select(F.btrim("value", F.lit(" \t\r\n")).alias("j")).where("j <> ''")
    objects = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    fields = lambda c: F.from_json(c, "map<string,string>")
    wrong = lambda why, c: F.raise_error(F.concat(F.lit(f"JSON-LD: {why}: "), F.coalesce(c, F.lit("null"))))
    tops = texts.select(F.explode(objects(F.col("j"))).alias("j")).select("j", fields(F.col("j")).alias("m"))
    opened = tops.select(F.explode(F.when(F.col("m")["@graph"].isNotNull(), objects(F.col("m")["@graph"])).otherwise(F.array("j"))).alias("j")).select("j", fields(F.col("j")).alias("m"))
    bad = (F.col("m").isNull() | (F.size("m") == 0)) & (F.col("j") != "{}") | F.map_contains_key("m", "@context")
    nodes = opened.select("j", F.when(bad, wrong("no expanded node", F.col("j")).cast("map<string,string>")).otherwise(F.col("m")).alias("m"))
    named = nodes.select(F.coalesce(F.col("m")["@id"], F.concat(F.lit("_:"), F.substring(F.sha2("j", 256), 1, 16))).alias("s"), F.explode("m").alias("p", "l")).where("l is not null and (p = '@type' or not startswith(p, '@'))")
    values = named.select("s", "p", F.explode(objects(F.col("l"))).alias("v"))
    v = F.col("m")
    parsed = values.select("s", "p", "v", F.when((F.col("p") != "@type") & F.col("v").startswith("{"), fields(F.col("v"))).alias("m"))
    nested = v.isNotNull() & (F.size(F.array_except(F.map_keys(v), F.array(*map(F.lit, ("@id", "@value", "@type", "@language", "@index"))))) > 0) | (v.isNotNull() & v["@id"].isNull() & v["@value"].isNull())
    plain = F.regexp_extract("v", r'"@value"\s*:\s*(true|false|-?[0-9][0-9.eE+-]*)', 1)
    native = F.when(v.isNull() | (plain == ""), None).when(plain.isin("true", "false"), XSD + "boolean").when(plain.rlike("[.eE]"), XSD + "double").otherwise(XSD + "integer")
    is_node = (F.col("p") == "@type") | v["@id"].isNotNull()
    o = F.when(nested, wrong("a list or a nested node", F.col("v"))).when(F.col("p") == "@type", F.col("v")).otherwise(F.coalesce(v["@id"], v["@value"], F.col("v")))
    dt = F.when(~is_node, F.coalesce(F.when(v["@language"].isNotNull(), F.lit("rdf:langString")), v["@type"], native))
    whole = parsed.select("s", F.when(F.col("p") == "@type", RDF + "type").otherwise(F.col("p")).alias("p"), o.alias("o"), is_node.alias("node"), dt.alias("dt"), v["@language"].alias("lang"))
    return whole.select("s", "p", "o", F.when(~F.col("node"), "literal").when(F.col("o").startswith("_:"), "bnode").otherwise("iri").alias("o_kind"), "dt", "lang")


def append_log(rows: DataFrame, path: str) -> None:
    """JSON lines, never rewritten."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a damaged line is an error, unknown fields are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tolerant: damaged lines are passed over; the last row (seq) of each cache_key."""
    rows = spark.read.schema(f"{schema}, damaged string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "damaged").json(path)
    good = rows.where(F.col("damaged").isNull() & F.col("cache_key").isNotNull()).drop("damaged")
    rest = [c for c in good.columns if c != "cache_key"]
    return good.groupBy("cache_key").agg(F.max_by(F.struct(*rest), "seq").alias("x")).select("cache_key", "x.*")


def read_labelled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with ',' or ';', told from the header line; columns are found by name, one that is missing is null.

    UTF-8 with or without a byte order mark, or, where that can't be read, windows-1252.
    """
    lines = spark.read.text(path)
    header = (lines.first() or [""])[0]
    encoding = "UTF-8" if lines.where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"
    rows = spark.read.option("header", True).option("sep", ";" if header.count(";") > header.count(",") else ",").option("encoding", encoding).csv(path)
    rows = rows.toDF(*[c.removeprefix("\ufeff").removeprefix("ï»¿").strip() for c in rows.columns])
    if encoding != "UTF-8":
        signs = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}  # where the two encodings differ
        rows = rows.select(*[F.translate(f"`{c}`", "".join(k for k, v in signs.items() if v), "".join(signs.values())).alias(c) for c in rows.columns])
    wanted = StructType.fromDDL(schema)
    return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The folders' columns, doc, page, text: form feeds end the pages of a file, line ends become \\n."""
    whole = spark.read.text(path, wholetext=True)
    whole = whole.select(*whole.columns[1:], F.col("_metadata.file_name").alias("doc"), F.regexp_replace(F.regexp_replace("value", "\f\\z", ""), "\r\n?", "\n").alias("value"))
    return whole.select(*whole.columns[:-1], F.posexplode(F.split("value", "\f")).alias("page", "text"))


def write_report(rows: DataFrame, path: str) -> None:
    """CSV: lists joined by '|', nulls empty."""
    flat = [F.array_join(c, "|").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes]
    rows.select(*flat).na.fill("").write.option("header", True).csv(path)


def write_candidates(rows: DataFrame, path: str, metadata: dict[str, str], by: str) -> None:
    """The candidate table as folders of one path: rows (JSON), counts by a column (JSON), metadata (JSON) and csv, lists joined by '|'."""
    kept = saved(rows)  # the table is made once, not for each folder
    kept.write.json(f"{path}/rows")
    kept.groupBy(by).agg(F.count(F.lit(1)).alias("n")).write.json(f"{path}/counts")
    kept.sparkSession.createDataFrame(sorted(metadata.items()), "name string, value string").write.json(f"{path}/metadata")
    write_report(kept, f"{path}/csv")


def merged_modules(modules: DataFrame, keep: str) -> DataFrame:
    """The statements of all modules as one set: their headers but that of `keep` go, and so do all imports of a module."""
    headers = modules.where("p = 'rdf:type' and o = 'owl:Ontology'").select("s").distinct()
    body = modules.join(headers.where(F.col("s") != keep), "s", "left_anti")
    imported = headers.select(F.col("s").alias("module"), F.lit("owl:imports").alias("how"))
    return body.join(imported, (body["o"] == imported["module"]) & (body["p"] == imported["how"]), "left_anti").dropDuplicates(["s", "p", "o", "dt", "lang"])


def merged_away(modules: DataFrame, keep: str) -> DataFrame:
    """The statements that `merged_modules` leaves out."""
    kept = merged_modules(modules, keep).select(*[F.col(c).alias(f"k_{c}") for c in ("s", "p", "o", "dt", "lang")])
    same = [modules[c].eqNullSafe(kept[f"k_{c}"]) for c in ("s", "p", "o", "dt", "lang")]
    return modules.dropDuplicates(["s", "p", "o", "dt", "lang"]).join(kept, reduce(Column.__and__, same), "left_anti")


def label_statements(added: DataFrame) -> DataFrame:
    """s, p, o, lang: one label statement for each language of the answers (key, labels map)."""
    return added.select(F.col("key").alias("s"), F.lit("rdfs:label").alias("p"), F.explode("labels").alias("lang", "o")).where("coalesce(o, '') <> ''").select("s", "p", "o", "lang")


def definition_statements(added: DataFrame) -> DataFrame:
    """A definition and its annotation node (a hash of the statement) with the source article. added: s, o, lang, article."""
    node = F.concat(F.lit("_:"), F.substring(F.sha2(F.concat_ws("\x1f", "s", "o"), 256), 1, 16))
    rows = F.array(
        F.struct(F.col("s"), F.lit("skos:definition").alias("p"), F.col("o"), F.col("lang")), F.struct(node.alias("s"), F.lit("owl:annotatedSource").alias("p"), F.col("s").alias("o"), F.lit(None).cast("string").alias("lang")),
        F.struct(node.alias("s"), F.lit("dct:source").alias("p"), F.concat(F.lit("art. "), F.col("article").cast("string")).alias("o"), F.lit(None).cast("string").alias("lang")),
    )
    return added.select(F.explode(rows).alias("x")).select("x.*")


def mapping_statements(mappings: DataFrame) -> DataFrame:
    """The mapping and what is said about it: what it is of, who, score, version. mappings: s, o, relation, by, score and maybe version.

    No relation: rdfs:seeAlso. What is null is not said.
    """
    relation = F.coalesce("relation", F.lit("rdfs:seeAlso"))
    node = F.concat(F.lit("_:"), F.substring(F.sha2(F.concat_ws("\x1f", "s", relation, "o"), 256), 1, 16))
    row = lambda s, p, o: F.struct(s.alias("s"), p.alias("p"), o.cast("string").alias("o"))
    said = {"owl:annotatedSource": F.col("s"), "owl:annotatedProperty": relation, "owl:annotatedTarget": F.col("o"), "decidedBy": F.col("by"), "confidence": F.col("score")}
    if "version" in mappings.columns:
        said["owl:versionInfo"] = F.col("version")
    rows = F.array(row(F.col("s"), relation, F.col("o")), *[row(node, F.lit(p), o) for p, o in said.items()])
    return mappings.select(F.explode(rows).alias("x")).select("x.*").where("o is not null")
