"""Data sources in Python: documents named by a manifest, and a telemetry sink whose batches appear whole or not at all."""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from corvina.session import share_code

#: Media types by file extension, and the extension a name gets that has none.
MEDIA = {
    "html": "text/html", "htm": "text/html", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "ndjson": "application/x-ndjson", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
#: Fixed value: bytes of a document that the served importer accepts at most.
MAX_BYTES = 10 * 1024 * 1024
SCHEMA = "url string, filename string, mime string, bytes long, content_hash string, content binary, error string"

#: Takes a manifest row and returns the document's bytes and its media type, if it knows one.
Fetcher = Callable[[dict], tuple[bytes, str | None]]


def inline(row: dict) -> tuple[bytes, str | None]:
    """The offline fetcher: the manifest's own content column, else a file path or file URL."""
    content = row.get("content")
    if content is not None:
        return (content if isinstance(content, bytes) else content.encode()), row.get("mime")
    fs, path = pafs.FileSystem.from_uri(row["url"]) if "://" in row["url"] else (pafs.LocalFileSystem(), row["url"])
    with fs.open_input_stream(path) as f:
        return f.read(), row.get("mime")


def filename(url: str, mime: str | None = None) -> str:
    """The last part of a URL's path with safe characters; index where there is none, an extension from the media type."""
    name = re.sub(r"[^a-zA-Z0-9._-]+", "_", unquote(urlsplit(url).path).rsplit("/", 1)[-1]) or "index"
    if "." in name:
        return name
    ends = [e for e, m in MEDIA.items() if mime and m == mime.split(";")[0].strip().lower()]
    return f"{name}.{ends[0] if ends else 'html'}"


def media_type(name: str, given: str | None = None) -> str:
    """The type that came with the document, else the one of its extension."""
    if given:
        return given.split(";")[0].strip().lower()
    return MEDIA.get(name.rsplit(".", 1)[-1].lower(), "application/octet-stream")


@dataclass
class Part(InputPartition):
    """One row group of the manifest: what a task reads."""

    path: str
    group: int

    def __init__(self, path: str, group: int):
        self.path, self.group = path, group


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else pafs.FileSystem.from_uri("file://" + os.path.abspath(uri))


class ManifestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.most = int(options.get("maxbytes", MAX_BYTES))
        module, _, name = options.get("fetcher", f"{__name__}:inline").partition(":")
        self.fetcher = (module, name)

    def partitions(self) -> list[Part]:
        """The manifest's row groups, from file footers: the driver reads no rows of it."""
        fs, path = _opened(self.options["path"])
        info = fs.get_file_info(path)
        files = [path] if info.is_file else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", ".")))
        return [Part(f, g) for f in files for g in range(pq.read_metadata(f, filesystem=fs).num_row_groups)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        """Each document of the row group, fetched on its own: one that fails is a row with an error."""
        fetch: Fetcher = getattr(importlib.import_module(self.fetcher[0]), self.fetcher[1])
        fs, _ = _opened(self.options["path"])
        given, names = pq.ParquetFile(fs.open_input_file(partition.path)), {self.options.get("url", "url"): "url", self.options.get("content", "content"): "content", "mime": "mime"}
        columns = [c for c in given.schema_arrow.names if c in names]
        for b in pq.ParquetFile(fs.open_input_file(partition.path)).iter_batches(batch_size=64, row_groups=[partition.group], columns=columns):
            rows = [self._document({names[k]: v for k, v in r.items()}, fetch) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, _arrow())

    def _document(self, row: dict, fetch: Fetcher) -> dict:
        url, out = row.get("url") or "", dict.fromkeys(("url", "filename", "mime", "bytes", "content_hash", "content", "error"))
        out |= {"url": row.get("url")}
        try:
            content, mime = fetch(row)
            out["filename"] = filename(url, mime)
            out |= {"mime": media_type(out["filename"], mime), "bytes": len(content)}
            if len(content) > self.most:
                return out | {"error": f"larger than {self.most} bytes"}
            return out | {"content_hash": hashlib.sha256(content).hexdigest(), "content": content}
        except Exception as e:  # noqa: BLE001 one document must not fail the rest
            return out | {"error": f"{type(e).__name__}: {e}"}


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])


class ManifestSource(DataSource):
    """spark.read.format("corvina_manifest").option("path", ...): options url and content name its columns, fetcher is module:function."""

    @classmethod
    def name(cls) -> str:
        return "corvina_manifest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ManifestReader(dict(self.options))


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int


class TelemetryWriter(DataSourceStreamWriter):
    """Tasks write JSON lines into staging files; a batch's commit file names those that count.

    The commit file is written under another name and moved, so a reader sees a batch whole or not at all. A batch that is
    run again after a failure finds its commit file and drops its own files. Lost tasks leave staging files that no commit names.
    """

    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, iterator: Iterator) -> Staged:
        fs, root = _opened(self.root)
        fs.create_dir(f"{root}/staging", recursive=True)
        file, rows = f"{root}/staging/{uuid.uuid4().hex}.json", 0
        with fs.open_output_stream(file) as out:
            for row in iterator:
                out.write((json.dumps(row.asDict(recursive=True), default=str, sort_keys=True) + "\n").encode())
                rows += 1
        return Staged(file, rows)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        fs, root = _opened(self.root)
        fs.create_dir(f"{root}/commits", recursive=True)
        name = f"{root}/commits/{batchId}.json"
        if fs.get_file_info(name).is_file:
            self._drop(fs, messages)
            return
        done = [m for m in messages if m is not None]
        with fs.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps({"batch": batchId, "files": [m.file for m in done if m.rows], "rows": sum(m.rows for m in done)}).encode())
        fs.move(f"{name}.tmp", name)
        self._drop(fs, [m for m in done if not m.rows])

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self._drop(_opened(self.root)[0], messages)

    @staticmethod
    def _drop(fs: pafs.FileSystem, messages: list[Staged | None]) -> None:
        for m in messages:
            if m is not None and fs.get_file_info(m.file).is_file:
                fs.delete_file(m.file)


class TelemetrySink(DataSource):
    """df.writeStream.format("corvina_telemetry").option("path", ...): read it back with :func:`telemetry`."""

    @classmethod
    def name(cls) -> str:
        return "corvina_telemetry"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return TelemetryWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    share_code(spark)
    spark.dataSource.register(ManifestSource)
    spark.dataSource.register(TelemetrySink)


def telemetry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches."""
    fs, root = _opened(path)
    files = []
    if fs.get_file_info(f"{root}/commits").type == pafs.FileType.Directory:
        for info in fs.get_file_info(pafs.FileSelector(f"{root}/commits")):
            if info.extension == "json":
                with fs.open_input_stream(info.path) as f:
                    files += json.loads(f.read())["files"]
    return spark.read.schema(schema).json(sorted(files)) if files else spark.createDataFrame([], schema)
