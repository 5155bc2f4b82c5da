"""Tables whose live files are named by a manifest, which one atomic rename puts in force.

folder/data holds files that are never changed; folder/manifests holds one JSON document a version; folder/CURRENT names the one in
force. A version is written whole before CURRENT moves, so a reader sees the table as it was before or after, never between, and
reads the files that the manifest names without listing a folder. What a failed writer leaves is named by no manifest.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class ManifestTable:
    """A table of parts (key -> rows and files), with the version before, so that readers under way and repeated batches find it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, path: str, text: str) -> None:
        p, fs = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _text(self, path: str) -> str | None:
        p, fs = self._fs(path)
        return self.spark.read.text(path, wholetext=True).first()[0] if fs.exists(p) else None

    def current(self) -> dict | None:
        name = self._text(f"{self.folder}/CURRENT")
        return json.loads(self._text(f"{self.folder}/manifests/{name}")) if name else None

    def before(self, batch: int) -> dict | None:
        """The newest version of an earlier batch: a batch that runs again starts from what it started from."""
        m = self.current()
        while m and m["batch"] >= batch:
            m = json.loads(self._text(f"{self.folder}/manifests/{m['previous']}")) if m["previous"] else None
        return m

    def stage(self, df: DataFrame, key: str) -> dict[str, dict]:
        """Write df below data, its rows of one value of key together, and say which files hold which value."""
        place = f"{self.folder}/data/{uuid.uuid4().hex}"
        df.repartition(key).write.partitionBy(key).parquet(place)
        parts: dict[str, dict] = {}
        p, fs = self._fs(place)
        for s in fs.listStatus(p):  # the writer's own folder, once
            name = s.getPath().getName()
            if "=" in name:
                value = self.spark._jvm.java.net.URLDecoder.decode(name.split("=", 1)[1].replace("+", "%2B"), "UTF-8")
                parts[value] = {"files": [f.getPath().toString() for f in fs.listStatus(s.getPath()) if f.getPath().getName().endswith(".parquet")]}
        return parts

    def commit(self, parts: dict[str, dict], batch: int, start: dict | None) -> None:
        """Put parts in force after ``start``, the version that they were made from. Of the version before that, files that neither names
        any more are deleted."""
        name = f"{batch:012d}-{uuid.uuid4().hex}.json"
        self._put(f"{self.folder}/manifests/{name}", json.dumps({"name": name, "batch": batch, "previous": start["name"] if start else None, "parts": parts}))
        self._put(f"{self.folder}/manifests/{name}.next", name)
        jvm = self.spark._jvm
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        new, here = self._fs(f"{self.folder}/manifests/{name}.next")[0], self._fs(f"{self.folder}/CURRENT")[0]
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(here.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, here, over)
        old = json.loads(self._text(f"{self.folder}/manifests/{start['previous']}")) if start and start["previous"] else {"parts": {}}
        for f in _files(old["parts"]) - _files(parts) - _files(start["parts"] if start else {}):
            p, fs = self._fs(f)
            fs.delete(p, False)

    def read(self, schema, version: dict | None = None, parts=None) -> DataFrame:
        """The rows of a version (the one in force, if not said), of the named parts or all."""
        m = version or self.current()
        files = sorted(_files({k: v for k, v in m["parts"].items() if parts is None or k in parts})) if m else []
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)


def _files(parts: dict[str, dict]) -> set[str]:
    return {f for p in parts.values() for f in p["files"]}
