"""Web archives: capture runs, and a globally ordered capture index by external merging.

``write_archives`` writes each row as a gzip member of a WARC 1.1 file in a shared folder, a file being cut
at ``RUN_RECORDS`` records, and returns the list of files.  Of records with equal payloads of at least
``SMALL`` bytes the one with the largest id is a response and the others are revisits that refer to it.
``read_runs`` reads the files back and writes for each one run file of its index lines, sorted by URL key and
capture time, in blocks of ``BLOCK`` lines.  ``merge_runs`` merges runs externally: passes of about ``FAN`` runs at a time with a
loser tree, each streaming a block per run, until so few are left; the last pass cuts the whole order into
ranges, finds where each range begins in every run by bisection over blocks, and merges the ranges at once.
So the ranges in order are the capture histories of all URLs, and a task holds ``FAN`` blocks.

Defined results: a null payload is empty, a null URL has the key ""; a null id counts as smaller than any
other and refers to nothing; rows equal in id and payload are all responses if their id is the largest;
payloads of any length are held one at a time; an empty table gives no files and no lines.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import scratch, table, written

SMALL = 1000
RUN_RECORDS, BLOCK, FAN, RANGE_LINES = 20_000, 1024, 64, 500_000
EPOCH = datetime.datetime(2020, 1, 1, tzinfo=datetime.UTC)
LINE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, run string, offset long"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the top domain down, then path and query; scheme, www, port 80 or 443, case of the host and fragment don't count."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return (url or "").strip().lower()
    tail = f":{port}" if port and port not in (80, 443) else ""
    return f"{','.join(reversed(host.split('.')))}{tail}){u.path or '/'}{'?' + u.query if u.query else ''}" if host else u.path


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header of the payload that it leaves out."""
    date = (EPOCH + datetime.timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = http if revisit else http + payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers (names in lower case), HTTP header and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    if len(body) < int(fields["content-length"]):
        raise ValueError("cut record")
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, http, payload


def members(stream: io.RawIOBase, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a file, one at a time."""
    offset, rest = 0, b""
    while True:
        rest = rest or stream.read(block)
        if not rest:
            return
        unzip, parts, used = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not rest:
                rest = stream.read(block)
                if not rest:
                    raise ValueError("cut archive")
            parts.append(unzip.decompress(rest))
            used += len(rest) - len(unzip.unused_data)
            rest = unzip.unused_data
        yield offset, b"".join(parts)
        offset += used


def _open(uri: str):
    """(file system, path) of a folder or file that any node can reach."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


def marked(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null unless a larger id has the same payload of SMALL bytes or more).

    Only ids and digests meet by digest; the payloads are shuffled once, by id.
    """
    body = F.coalesce(pages[payload].cast("string"), F.lit(""))
    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), body.alias("payload"), F.sha1(body.cast("binary")).alias("digest"))
    ids = rows.filter(F.octet_length("payload") >= SMALL).select("page_id", "digest")
    groups = written(ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n"), "payloads")
    revisits = ids.join(groups, "digest").filter("NOT (page_id <=> refers_to)").distinct()
    revisits = written(revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to"), "revisits")
    return rows.join(revisits, rows.page_id.eqNullSafe(revisits.r_id) & (rows.digest == revisits.r_digest), "left").drop("r_id", "r_digest")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives under the folder, a URI that every node reaches; a row (archive, records) per file.

    Files are named by task attempt and listed only by the attempt that ends well, so a lost executor
    leaves unlisted files at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        made: list[tuple[str, int]] = []
        out, n = None, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(batch.num_columns)), strict=True):
                page_id, link, text, digest, refers = (v.as_py() for v in row)
                if out is None or n >= RUN_RECORDS:
                    if out is not None:
                        out.close()
                        made[-1] = (made[-1][0], n)
                    name = f"captures-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz"
                    out, n = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                    made.append((name, 0))
                out.write(gzip.compress(record(page_id, link, text.encode(), digest, refers), 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            made[-1] = (made[-1][0], n)
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["archive", "records"])

    rows = marked(pages, key, url, payload).select("page_id", "url", "payload", "digest", "refers_to")
    return written(rows.mapInArrow(run, "archive string, records long"), "archives")


def _line(fields: dict[str, str], http: bytes, payload: bytes, run: str, offset: int) -> tuple:
    number = lambda x: int(x[len("<urn:page:") : -1] or -1) if x else None
    page = fields["warc-record-id"][len("<urn:page:") : -1]
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of page {page} differs from its digest")
    else:
        size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length: ")).split(" ")[1])
    return int(page) if page else None, size, digest, kind, number(fields.get("warc-refers-to")), url_key(fields.get("warc-target-uri")), fields["warc-date"], run, offset


def _batch(lines: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if part.endswith("long") else pa.string() for part in LINE.split(", ")]
    columns = list(zip(*lines, strict=True)) if lines else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [part.split(" ")[0] for part in LINE.split(", ")])


def order(line: tuple) -> tuple:
    """URL key, capture time, then file and place, which makes the order total."""
    return line[5], line[6], line[7], line[8]


def write_run(fs: pyarrow.fs.FileSystem, path: str, lines: Iterable[tuple], block: int) -> list[tuple]:
    """Writes sorted lines as a run file of blocks; gives (lines, first key) of each block."""
    made, held = [], []
    with fs.open_output_stream(path, compression=None) as sink, pa.ipc.new_file(sink, _batch([]).schema) as out:
        for x in chain(lines, [None]):
            if held and (x is None or len(held) == block):
                out.write_batch(_batch(held))
                made.append((len(held), *order(held[0])))
                held = []
            held.append(x)
    return made


def run_slice(fs: pyarrow.fs.FileSystem, path: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """The lines of a run from low on, below high, a block at a time."""
    with fs.open_input_file(path) as file:
        blocks = pa.ipc.open_file(file)
        lines = lambda i: list(zip(*(c.to_pylist() for c in blocks.get_batch(i).columns), strict=True))
        at, end = 0, blocks.num_record_batches
        if low is not None:
            # the last block that begins at or below low, or the first of all
            while end - at > 1:
                mid = (at + end) // 2
                if order(lines(mid)[0]) <= low:
                    at = mid
                else:
                    end = mid
        for i in range(at, blocks.num_record_batches):
            for x in lines(i):
                key = order(x)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield x


_RUNS = "file string, lines long, url_key string, captured string, run string, offset long"


def _blocks(file: str, made: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*made, strict=True)) if made else [()] * 5
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([file] * len(made), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split(" ")[0] for x in _RUNS.split(", ")])


def _run_name(number: int) -> str:
    """A run file's name by task attempt, so that a lost executor leaves unlisted files at most."""
    task = TaskContext.get()
    return f"run-{task.stageId()}-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.arrow"


def read_runs(archives: DataFrame, folder: str) -> DataFrame:
    """A row per block of the run files, one run for each archive: file, lines and first key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        n = 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    lines = [_line(*parse(raw), name, offset) for offset, raw in members(stream)]  # RUN_RECORDS at most
                file, n = _run_name(n), n + 1
                yield _blocks(file, write_run(fs, f"{root}/{file}", sorted(lines, key=order), BLOCK))

    files = archives.select("archive")
    return written(files.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4), "archive").mapInArrow(run, _RUNS), "runs")


class LoserTree:
    """Merges k sorted runs: inner nodes keep the loser of their match, so a line costs log k comparisons on one path."""

    def __init__(self, runs: list[Iterable], key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, max(1, len(runs))
        self.lines = [None] * self.k
        self.heads = [None] * self.k
        for i in range(len(runs)):
            self._next(i)
        self.tree = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _next(self, i: int) -> None:
        for x in self.runs[i]:
            self.lines[i], self.heads[i] = x, self.key(x)
            return
        self.lines[i] = self.heads[i] = None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.tree[node] = lost
        return won

    def __iter__(self):
        while self.heads[self.winner] is not None:
            w = self.winner
            yield self.lines[w]
            self._next(w)
            node = (w + self.k) // 2
            while node:
                if not self._beats(w, self.tree[node]):
                    w, self.tree[node] = self.tree[node], w
                node //= 2
            self.winner = w


def merge_pass(runs: DataFrame, folder: str, groups: int) -> DataFrame:
    """Fewer and longer runs: each group of files merged into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        n = 0
        for batch in batches:
            for files in batch.column(0).to_pylist():
                file, n = _run_name(n), n + 1
                yield _blocks(file, write_run(fs, f"{root}/{file}", LoserTree([run_slice(fs, f"{root}/{f}") for f in files], order), BLOCK))

    files = runs.select("file").distinct().groupBy(F.pmod(F.xxhash64("file"), F.lit(groups)).alias("g")).agg(F.collect_list("file").alias("files"))
    return written(files.select("files").mapInArrow(run, _RUNS), "runs")


def merge_runs(runs: DataFrame, folder: str) -> DataFrame:
    """All index lines in global order by URL key and time, with part and place: the range and the position in it.

    Ranges are cut by the whole order, so one URL or host with many captures spreads over ranges.
    """
    spark = runs.sparkSession
    while (many := runs.select("file").distinct().count()) > FAN:
        runs = merge_pass(runs, folder, -(-many // (FAN * 3 // 4)))
    keys = ["url_key", "captured", "run", "offset"]
    size = runs.agg(F.count("*").alias("blocks"), F.sum("lines").alias("lines")).first()
    parts = max(1, min(size["blocks"], max(2 * spark.sparkContext.defaultParallelism, (size["lines"] or 0) // RANGE_LINES)))
    least = runs.repartitionByRange(parts, *keys).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*keys)).alias("low"))
    # FAN names and a key for each RANGE_LINES lines, and for each core
    files = [r["file"] for r in runs.select("file").distinct().collect()]
    lows = sorted(tuple(r["low"]) for r in least.collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)

        def out(part: int, held: list[tuple], place: int) -> pa.RecordBatch:
            b = _batch(held)
            return pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(held), pa.int32()), pa.array(range(place - len(held), place), pa.int64())], [*b.schema.names, "part", "place"])

        for part in (p for batch in batches for p in batch.column(0).to_pylist()):
            high = lows[part + 1] if part + 1 < len(lows) else None
            held, place = [], 0
            for x in LoserTree([run_slice(fs, f"{root}/{f}", lows[part], high) for f in files], order):
                held.append(x)
                place += 1
                if len(held) == 10_000:
                    yield out(part, held, place)
                    held = []
            yield out(part, held, place)

    return spark.range(0, len(lows), numPartitions=max(1, len(lows))).mapInArrow(run, f"{LINE}, part int, place long")


def op9_archive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    histories = merge_runs(read_runs(archives, folder), folder)
    return histories.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
