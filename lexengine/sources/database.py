"""The dictionary database: tables in folders, partitioned by dictionary, and their maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexengine.operators.results import valid_url
from lexengine.sources.archive import Tables

NAMES = ("dictionaries", "terms", "term_meta", "kanji", "kanji_meta", "tags", "media")
_KEY = {"dictionaries": "title"}


class Database:
    """Tables below a folder that all machines share. Rows of a dictionary lie in folders of their own, so that they come and go alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def has(self, name: str) -> bool:
        """Whether a table holds rows: each dictionary's lie in a folder."""
        at = self._path(self._at(name))
        return self._fs.exists(at) and any(x.isDirectory() and x.getPath().getName().startswith("part=") for x in self._fs.listStatus(at))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(name))

    def titles(self) -> list[str]:
        return sorted(r.title for r in self.table("dictionaries").select("title").collect()) if self.has("dictionaries") else []

    def add(self, tables: Tables) -> None:
        """Adds the dictionaries of tables; a title that is there already is refused."""
        new = {r.title for r in tables.dictionaries.select("title").collect()}
        if known := new & set(self.titles()):
            raise ValueError(f"already imported: {sorted(known)}")
        # the summary comes last: without it nothing of a dictionary counts as imported
        for name in NAMES[1:] + NAMES[:1]:
            rows = getattr(tables, name)
            key = _KEY.get(name, "dictionary")
            rows.withColumn("part", F.col(key)).write.mode("append").partitionBy("part").parquet(self._at(name))

    def delete(self, title: str) -> dict[str, int]:
        """Deletes a dictionary; how many rows of each table went."""
        gone = {}
        for name in NAMES:
            if self.has(name):
                own = self.table(name)
                gone[name] = own.filter(F.col("part") == title).count()
                for status in self._fs.listStatus(self._path(self._at(name))):
                    if status.isDirectory() and self._title_of(status.getPath().getName()) == title:
                        self._fs.delete(status.getPath(), True)
        return gone

    def _title_of(self, folder: str) -> str | None:
        if not folder.startswith("part="):
            return None
        return self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder[5:])

    def purge(self) -> None:
        self._fs.delete(self._path(self.folder), True)

    def counts(self) -> DataFrame:
        """dictionary, name, n: rows of each table by dictionary, and of all where dictionary is null."""
        out = None
        for name in NAMES[1:]:
            if self.has(name):
                n = self.table(name).rollup(F.col("part").alias("dictionary")).agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
                out = n if out is None else out.unionByName(n)
        return out

    def incomplete(self) -> list[str]:
        """Titles with rows but without a summary: imports that broke off, to be deleted at the start."""
        known = set(self.titles())
        return sorted({r.part for name in NAMES[1:] if self.has(name) for r in self.table(name).select("part").distinct().collect()} - known)

    def update(self, title: str, **values) -> int:
        """Sets columns of a dictionary's summary; how many rows changed. Other tables are not updated, a dictionary is added anew for that."""
        own = self.table("dictionaries").filter(F.col("part") == title)
        if unknown := set(values) - set(own.columns) | (set(values) & {"title", "part"}):
            raise ValueError(f"no such column: {sorted(unknown)}")
        n = own.count()
        if n:
            self._swap("dictionaries", title, own.withColumns({k: F.lit(v).cast(own.schema[k].dataType) for k, v in values.items()}), title)
        return n

    def rename(self, title: str, to: str) -> None:
        """Gives a dictionary another title. Its tables are written under the new one first, the summary last; then the old ones go."""
        if to in self.titles():
            raise ValueError(f"already imported: {to}")
        for name in NAMES[1:] + NAMES[:1]:
            if self.has(name):
                own = self.table(name).filter(F.col("part") == title)
                if not own.isEmpty():
                    self._swap(name, to, own.withColumn(_KEY.get(name, "dictionary"), F.lit(to)), None)
        self.delete(title)

    def replace(self, title: str, staging: str) -> None:
        """Puts a dictionary that was added as staging in place of title. The old one keeps its rows until the new ones are written."""
        if staging not in self.titles():
            raise ValueError(f"not imported: {staging}")
        kept = f"{title} [replaced {uuid.uuid4().hex}]"
        if title in self.titles():
            self.rename(title, kept)
        self.rename(staging, title)
        self.delete(kept)

    def _swap(self, name: str, title: str, rows: DataFrame, old: str | None) -> None:
        """Writes rows as the folder of title; rows may come from the folder that they replace."""
        draft = f"{self.folder}/.draft-{uuid.uuid4().hex}"
        rows.withColumn("part", F.lit(title)).write.partitionBy("part").parquet(draft)
        if old is not None:
            for status in self._fs.listStatus(self._path(self._at(name))):
                if status.isDirectory() and self._title_of(status.getPath().getName()) == old:
                    self._fs.delete(status.getPath(), True)
        for status in self._fs.listStatus(self._path(draft)):
            if status.isDirectory():
                self._fs.rename(status.getPath(), self._path(f"{self._at(name)}/{status.getPath().getName()}"))
        self._fs.delete(self._path(draft), True)

    def with_ids(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with id, from the largest one of the table on, in an order that a rerun repeats: of equal rows any."""
        first = self.table(name).agg(F.max("id")).first()[0] if self.has(name) and "id" in self.table(name).columns else None
        # numbers by parts of the order: how many rows stand in the parts before, and the place within
        own = rows.withColumn("h__", F.xxhash64(*rows.columns)).withColumn("part__", F.shiftright("h__", 52))
        sizes = own.groupBy("part__").agg(F.count("*").alias("n__"))  # 4,096 parts at most
        before = sizes.withColumn("before__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        place = F.row_number().over(Window.partitionBy("part__").orderBy("h__"))
        start = 0 if first is None else first
        return own.join(F.broadcast(before), "part__").withColumn("id", (F.col("before__") + place + start).cast("long")).drop("h__", "part__", "n__", "before__")

    def media(self, wanted: DataFrame) -> DataFrame:
        """wanted (dictionary, path) with content: null where there is none. Requests that repeat are looked up once."""
        found = self.table("media").select("dictionary", "path", "content")
        return wanted.join(wanted.select("dictionary", "path").distinct().join(found, ["dictionary", "path"]), ["dictionary", "path"], "left")

    def cleaned(self, flag: str = "importSuccess") -> list[str]:
        """Deletes what broken imports left: dictionaries without a summary, and those whose summary says that they failed."""
        gone = self.incomplete()
        if self.has("dictionaries") and flag in (own := self.table("dictionaries")).columns:
            gone += [r.title for r in own.filter(~F.coalesce(F.col(flag).cast("boolean"), F.lit(True))).select("title").collect()]
        for title in gone:
            self.delete(title)
        return sorted(gone)

    def probe(self, title: str) -> str | None:
        """The first expression of a dictionary that isn't blank."""
        own = self.table("terms").filter((F.col("part") == title) & (F.trim("expression") != ""))
        row = own.select("expression").limit(1).collect()
        return row[0].expression if row else None

    def export(self, folder: str) -> None:
        for name in NAMES:
            if self.has(name):
                self.table(name).write.partitionBy("part").parquet(f"{folder}/{name}")


def restored(folder: str, database: Database) -> None:
    """Replaces the whole database by an exported one. The old tables go once the new ones can be read."""
    tables = {name: database.spark.read.parquet(f"{folder}/{name}") for name in NAMES if database._fs.exists(database._path(f"{folder}/{name}"))}
    if "dictionaries" not in tables:
        raise ValueError(f"no database in {folder}")
    database.purge()
    for name, rows in tables.items():
        rows.write.partitionBy("part").parquet(database._at(name))


def summary(index: DataFrame, terms: DataFrame) -> DataFrame:
    """title, revision, format, n_terms, updatable of imported dictionaries: updatable where both of its addresses can be opened."""
    n = terms.groupBy(F.col("dictionary").alias("title")).agg(F.count("*").alias("n_terms"))
    have = lambda c: F.col(c) if c in index.columns else F.lit(None).cast("string")
    ok = valid_url(have("indexUrl")) & valid_url(have("downloadUrl"))
    return index.join(n, "title", "left").select("title", have("revision").alias("revision"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), ok.alias("updatable"))


def deduplicated(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """terms with a content_hash in place of their contents, and the contents, each once."""
    contents = ["rules", "definition_tags", "term_tags", "glossary"]
    own = terms.withColumn("content_hash", F.sha2(F.to_json(F.struct(*contents)), 256))
    return own.drop(*contents), own.select("content_hash", *contents).dropDuplicates(["content_hash"])
