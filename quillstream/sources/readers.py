"""Readers: meeting and register CSV, XLSX, paged JSON, nested transcripts, feeds, landed speech rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import dates as D
from ..operators import predicates as P

#: Words in a header that give a column its role, in the order in which roles are looked for.
ROLES = {"minister": ["minister"], "date": ["date"], "organisation": ["organisation", "organization"], "purpose": ["purpose", "subject"]}
REQUIRED = ["minister", "date", "organisation"]
DEBATE = "struct<Title string, Date string, Location string, HRSTag string, House string, NextDebateExtId string, PreviousDebateExtId string, ExtId string>"
ITEM = "struct<ItemType string, HRSTag string, Value string, MemberId bigint, MemberName string, AttributedTo string>"


def files_of(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), uri) if ":/" not in uri else pafs.FileSystem.from_uri(uri)


def not_utf8(spark: SparkSession, path: str) -> list[str]:
    """The files whose bytes are no UTF-8. They are tried line by line, in pieces as Spark splits them: no character's bytes hold a line's end. One name a file comes to the driver."""
    lines = spark.read.text(path)
    return sorted(unquote(r[0]) for r in lines.where(~F.is_valid_utf8("value")).select(F.input_file_name()).distinct().collect())


def _windows_1252() -> tuple[str, str]:
    """The characters between U+0080 and U+009F of a text read as Latin-1, and what Windows-1252 means by them."""
    codes = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
    return "".join(map(chr, codes)), bytes(codes).decode("cp1252")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Text columns by header; a byte-order mark is no part of the first name. Each file has its own encoding: UTF-8 if its bytes are, else Windows-1252
    (read as Latin-1, whose codes it extends). A column that the files of one encoding alone have is null in the others."""
    other = not_utf8(spark, path)
    every = [unquote(f) for f in spark.read.text(path).inputFiles()]
    plain = [f for f in every if f not in set(other)] if other else [path]
    reader = lambda encoding, files: spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(files)
    bare = lambda df: df.toDF(*(c.lstrip("\ufeff").removeprefix("\u00ef\u00bb\u00bf").strip() for c in df.columns))
    found = bare(reader("UTF-8", plain)) if plain else None
    if other:
        theirs, meant = _windows_1252()
        df = reader("ISO-8859-1", other)
        names = [c.translate(str.maketrans(theirs, meant)) for c in df.columns]
        df = bare(df.select(*(F.translate(F.col(f"`{c}`"), theirs, meant).alias(n) for c, n in zip(df.columns, names, strict=True))))
        found = df if found is None else found.unionByName(df, allowMissingColumns=True)
    return found


def roles(columns: list[str]) -> dict[str, str]:
    """The first column for each role; an error if a required one is missing."""
    found = {}
    for role, words in ROLES.items():
        for c in columns:
            if c not in found.values() and any(w in c.lower() for w in words):
                found[role] = c
                break
    if missing := [r for r in REQUIRED if r not in found]:
        raise ValueError(f"no column for {', '.join(missing)} among {columns}")
    return found


def meetings(raw: DataFrame, department: str, source_url: str, internal: list[str]) -> DataFrame:
    """A row per meeting and organisation with its outcome: pending, rejected (a body of the government), nil or errored, and notes."""
    r = roles(raw.columns)
    c = {k: F.trim(F.coalesce(F.col(f"`{v}`"), F.lit(""))) for k, v in r.items()} | ({} if "purpose" in r else {"purpose": F.lit("")})
    rows = raw.select(*(v.alias(k) for k, v in c.items()), F.to_json(F.struct(*(F.col(f"`{x}`") for x in raw.columns))).alias("source_csv_row"))
    nil = (F.col("organisation") == "") | F.lower("organisation").rlike(r"^nil( return)?s?\b") | F.lower("minister").rlike(r"^nil( return)?\b")
    dated = rows.withColumn("nil", nil).withColumn("_d", D.noted_date(F.col("date"))).withColumn("many", F.size(F.split("organisation", ",")) > 4)
    names = F.filter(F.transform(F.split("organisation", ";"), lambda x: F.trim(x)), lambda x: x != "")
    each = dated.withColumn("raw_organisation_name", F.explode_outer(names)).withColumn("internal", P.whole_word(F.col("raw_organisation_name"), internal))
    notes = F.concat_ws("; ", F.col("_d.note"), F.when(F.col("many"), "possible list of organisations in one field"), F.concat(F.lit("internal government: "), "internal"))
    outcome = F.when(F.col("nil"), "nil").when(F.col("_d.date").isNull(), "errored").when(F.col("internal").isNotNull(), "rejected").otherwise("pending")
    return each.select("raw_organisation_name", F.col("minister").alias("minister_name"), F.lit(department).alias("department"), F.col("_d.date").alias("meeting_date"), F.col("purpose").alias("meeting_purpose"), F.lit(source_url).alias("source_url"), "source_csv_row", outcome.alias("processing_status"), notes.alias("processing_notes"))


def register_entries(raw: DataFrame, quarter: str, start: str, end: str, internal: list[str]) -> DataFrame:
    """Two rows per registered firm and client, the firm's and the client's, unless a name is empty or stands for none."""
    firm, client = (F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in raw.columns[:2])
    good = raw.select(firm.alias("firm_name"), client.alias("client_name")).where((F.col("firm_name") != "") & (F.col("client_name") != "") & ~P.is_placeholder(F.col("firm_name")) & ~P.is_placeholder(F.col("client_name")))
    status = F.when(P.whole_word(F.col("client_name"), internal).isNotNull(), "rejected").otherwise("pending")
    kinds = F.array(F.lit("firm"), F.lit("client"))
    return good.select("firm_name", "client_name", F.explode(kinds).alias("record_type"), F.lit(quarter).alias("quarter"), F.lit(start).cast("date").alias("quarter_start_date"), F.lit(end).cast("date").alias("quarter_end_date"), status.alias("processing_status"))


class _Files(DataSourceReader):
    """A partition per file of a folder or of one file."""

    suffix = ""

    def __init__(self, options: dict):
        self.options, self.path = options, options["path"]

    def partitions(self) -> list[InputPartition]:
        files, folder = files_of(self.path)
        info = files.get_file_info(folder)
        names = [folder] if info.is_file else sorted(x.path for x in files.get_file_info(pafs.FileSelector(folder)) if x.path.lower().endswith(self.suffix) and not x.base_name.startswith((".", "_")))
        return [InputPartition(n) for n in names]

    def bytes_of(self, partition: InputPartition) -> bytes:
        files, _ = files_of(self.path)
        with files.open_input_file(partition.value) as f:
            return f.read()


class XlsxReader(_Files):
    suffix = ".xlsx"

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Text of the first columns of the first sheet from a row on; rows blank in all of them are left out."""
        import io
        import zipfile
        from xml.etree import ElementTree

        width, first = int(self.options.get("columns", 2)), int(self.options.get("firstrow", 4))
        name = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        with zipfile.ZipFile(io.BytesIO(self.bytes_of(partition))) as book:
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                shared = ["".join(t.text or "" for t in item.iter(f"{name}t")) for item in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot()]
            for _, row in ElementTree.iterparse(book.open("xl/worksheets/sheet1.xml")):
                if row.tag != f"{name}row":
                    continue
                if int(row.get("r", 0)) >= first:
                    cells: list = [None] * width
                    for cell in row.iter(f"{name}c"):
                        letters = "".join(ch for ch in cell.get("r", "") if ch.isalpha())
                        at = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters))) - 1
                        if 0 <= at < width:
                            value, inline = cell.find(f"{name}v"), cell.find(f"{name}is")
                            text = "".join(t.text or "" for t in inline.iter(f"{name}t")) if inline is not None else value.text if value is not None else None
                            cells[at] = shared[int(text)] if cell.get("t") == "s" and text else text
                    if any((c or "").strip() for c in cells):
                        yield tuple(cells)
                row.clear()


class XlsxSource(DataSource):
    """``spark.read.format("register_xlsx").option("columns", 2).option("firstRow", 4)``"""

    @classmethod
    def name(cls) -> str:
        return "register_xlsx"

    def schema(self) -> str:
        return ", ".join(f"c{i} string" for i in range(int(self.options.get("columns", 2))))

    def reader(self, schema) -> DataSourceReader:
        return XlsxReader({k.lower(): v for k, v in self.options.items()})


class PageReader(_Files):
    suffix = ".json"

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Each item of a landed page as JSON text, with the page's total; a page that can't be parsed gives nothing."""
        try:
            page = json.loads(self.bytes_of(partition))
        except ValueError:
            return
        items = page.get("items", page.get("results", [])) if isinstance(page, dict) else page
        for item in items or []:
            yield partition.value.rpartition("/")[2], (page.get("totalResults") if isinstance(page, dict) else len(items)), json.dumps(item, ensure_ascii=False)


class PageSource(DataSource):
    """``spark.read.format("json_pages").load(folder)``: landed API pages, a partition per page."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "page string, total long, item string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (XlsxSource, PageSource):
        spark.dataSource.register(source)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """By the file's suffix."""
    register(spark)
    return spark.read.format("register_xlsx").load(path) if path.lower().endswith(".xlsx") else read_csv(spark, path)


PUBLICATION = "struct<id bigint, publicationDate string, committeeBusinesses array<struct<id bigint, title string>>, committeeBusiness struct<id bigint, title string>, witnesses array<struct<id bigint, name string, submitterType string, organisations array<struct<name string, role string>>>>>"


def evidence(pages: DataFrame, oral: bool, committee: str, internal: list[str]) -> DataFrame:
    """A row per publication, witness and organisation; names with ; are several; bodies of the government are left out; an individual's role has their name."""
    p = pages.select(F.from_json("item", PUBLICATION).alias("p")).select("p.*")
    business = F.coalesce(F.get("committeeBusinesses", F.lit(0)), F.col("committeeBusiness"))
    witnesses = p.select("id", D.iso_date(F.col("publicationDate")).alias("publication_date"), business["id"].alias("inquiry_id"), business["title"].alias("inquiry_title"), F.explode("witnesses").alias("w"))
    named = witnesses.select("*", F.explode("w.organisations").alias("o"))
    role = F.when(F.lower("w.submitterType") == "individual", F.concat_ws(", ", "w.name", F.nullif("o.role", F.lit("")))).otherwise(F.col("o.role"))
    each = named.select("id", "publication_date", "inquiry_id", "inquiry_title", role.alias("role"), F.explode(F.filter(F.transform(F.split("o.name", ";"), lambda x: F.trim(x)), lambda x: x != "")).alias("raw_organisation_name"))
    url = F.format_string(f"https://committees.example.org/publications/%d/{'transcript' if oral else 'documents'}", F.col("id"))
    return each.where(P.whole_word(F.col("raw_organisation_name"), internal).isNull()).select(F.col("id").alias("publication_id"), "raw_organisation_name", "role", "publication_date", "inquiry_id", "inquiry_title", F.lit(committee).alias("committee"), url.alias("source_url"))


#: Levels of nested sections that are read at once; what lies deeper is read in further passes.
DEPTH = 6


def debate_schema(depth: int = DEPTH) -> str:
    """Sections within sections; the children of the deepest are left as text."""
    return f"struct<Overview {DEBATE}, Items array<{ITEM}>, ChildDebates array<{'string' if depth == 0 else debate_schema(depth - 1)}>>"


def debates(documents: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """Sections (ext_id, parent_ext_id, title, date, house, location, hrs_tag, next, previous) with their speeches in document order.

    Children come before the items of what follows them. Sections may be nested to any depth: a pass reads `depth` further levels and keeps what lies below as text for the next.
    """
    from ..functions.classify import is_speech_item
    from ..storage import kept

    below = documents.select(F.col(column).alias("text"), F.lit(None).cast("string").alias("root"), F.lit(None).cast("string").alias("parent"), F.array().cast("array<int>").alias("path"))
    out = None
    while out is None or not below.isEmpty():
        level = below.select(F.from_json("text", debate_schema(depth)).alias("d"), "root", "parent", "path").select("d.*", F.coalesce("root", "d.Overview.ExtId").alias("root"), "parent", "path")
        for k in range(depth + 1):
            items = level.select("root", "parent", "path", "Overview", F.posexplode_outer("Items").alias("at", "item"))
            out = items if out is None else out.unionByName(items)
            child = level.select("root", F.col("Overview.ExtId").alias("parent"), "path", F.posexplode("ChildDebates").alias("n", "d")).select("d", "root", "parent", F.concat("path", F.array("n")).alias("path"))
            level = child.select("d.*", "root", "parent", "path") if k < depth else None
        below = kept(child.where("d IS NOT NULL").withColumnRenamed("d", "text"), "deeper-sections")
    spoken = is_speech_item(F.col("item.ItemType"), F.col("item.HRSTag"), F.col("item.Value"))
    o = "Overview"
    return out.select(
        "root", F.col(f"{o}.ExtId").alias("ext_id"), F.col("parent").alias("parent_ext_id"), F.col(f"{o}.Title").alias("title"), D.iso_date(F.col(f"{o}.Date")).alias("date"), F.col(f"{o}.House").alias("house"), F.col(f"{o}.Location").alias("location"), F.col(f"{o}.HRSTag").alias("hrs_tag"),
        F.col(f"{o}.NextDebateExtId").alias("next_ext_id"), F.col(f"{o}.PreviousDebateExtId").alias("previous_ext_id"), "path", "at", F.when(spoken, F.col("item")).alias("item"),
    )


def speeches(sections: DataFrame) -> DataFrame:
    """The speeches of `debates` with a 0-based order within their section."""
    from pyspark.sql import Window

    from ..functions import text as T

    n = F.row_number().over(Window.partitionBy("ext_id").orderBy("path", "at")) - 1
    kept = sections.where("item IS NOT NULL")
    return kept.select("ext_id", n.alias("speech_order"), F.col("item.MemberId").alias("member_id"), F.coalesce("item.AttributedTo", "item.MemberName").alias("member_name"), T.last_group_party(F.coalesce("item.AttributedTo", "item.MemberName")).alias("party"), T.paragraphs(F.col("item.Value")).alias("speech_text"))


def feed(spark: SparkSession, path: str, topic: str, most: int = 15, first: int = 40) -> DataFrame:
    """Of a landed RSS feed's first entries, in the order in which they stand there, those that hold a word of the topic."""
    df = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    placed = df.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(first)
    return placed.where(P.any_word(F.concat_ws(" ", "title", "description"), topic)).orderBy("_at").limit(most).drop("_at")


def posts(spark: SparkSession, path: str, topic: str, most: int = 10) -> DataFrame:
    """Of landed posts (JSON lines with text and uri), those that hold a word of the topic."""
    return spark.read.schema("uri string, text string, createdAt string").json(path).where(P.any_word(F.col("text"), topic)).orderBy(F.desc("createdAt"), "uri").limit(most)


def looks_parliamentary(content: Column, markers: list[str], least: int = 2) -> Column:
    """At least so many markers in the first 3,000 characters."""
    head = F.lower(F.left(content, F.lit(3000)))
    return sum((head.contains(m.lower()).cast("int") for m in markers), F.lit(0)) >= least


def jdbc_table(spark: SparkSession, url: str, name: str, low: int, high: int, partitions: int) -> DataFrame:
    """A table by ranges of its id."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn="id", lowerBound=low, upperBound=high, numPartitions=partitions).load()
