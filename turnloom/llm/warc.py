"""Deterministic sharded WARC writer and reader.

Records are ordered by page_id, then by a hash of the record. Each is one gzip member, so the
places where files roll follow from the running sum of member sizes alone: shard k holds the
members whose sum before them lies in the k-th stretch of ``roll_bytes``. Names, record ids, headers and digests are made from the
row, so equal input gives equal files however Spark splits the work. A ledger of sizes comes first,
in which a revisit stands whole and a response only with the size of its member; pages and ledger
meet in the task that writes their shard, so html is shuffled once and no member is kept beside the archives. A task writes a shard under
a temporary name and renames it when it is whole; the manifest that is written at the end names
the shards that count, and the reader opens those only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import staged

ROLL_BYTES = 16 << 20
#: Payloads of at least this many bytes are stored once; others are repeated.
REVISIT_FROM = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20

MANIFEST = "shard long, file string, n_records long, n_bytes long, sha256 string, first_page long, last_page long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"


def _base32(data: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def _uri(url: str | None, page_id) -> str:
    from urllib.parse import quote

    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    import zlib

    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def response(page_id, url: str | None, html: str | None) -> bytes:
    """A response record: the payload is the html in UTF-8, empty for null."""
    payload = (html or "").encode()
    block = _http(len(payload)) + payload
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, page_id)),
        ("WARC-Payload-Digest", f"sha1:{_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Page-ID", "" if page_id is None else str(page_id)),
    ]
    return _member(fields, block)


def revisit(page_id, url: str | None, size: int, digest: str, to, to_url: str | None) -> bytes:
    """A revisit record: the payload is that of the response of page ``to``."""
    block = _http(size)
    fields = [
        ("WARC-Type", "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, page_id)),
        ("WARC-Profile", PROFILE),
        ("WARC-Refers-To", record_id(to)),
        ("WARC-Refers-To-Target-URI", _uri(to_url, to)),
        ("WARC-Refers-To-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Page-ID", "" if page_id is None else str(page_id)),
        ("Refers-To-Page-ID", "" if to is None else str(to)),
        ("Payload-Length", str(size)),
    ]
    return _member(fields, block)


def _measured(batches):
    """What is known of a record before it is placed; a response is made for its size alone."""
    import pyarrow as pa

    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True))
        payloads = [(html or "").encode() for _, _, html in rows]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("page_id", "tie", "url", "sha")),
                pa.array([len(x) for x in payloads], pa.int64()),
                pa.array([_base32(x) for x in payloads], pa.string()),
                pa.array([len(response(*row)) for row in rows], pa.int64()),
            ],
            names=["page_id", "tie", "url", "sha", "size", "digest", "bytes"],
        )


def _entered(batches):
    """The ledger's rows: a revisit is whole, of a response the size is enough."""
    import pyarrow as pa

    names = ("page_id", "url", "size", "digest", "to", "to_url", "again")
    for batch in batches:
        members = [
            revisit(page_id, url, size, digest, to, to_url) if again else None
            for page_id, url, size, digest, to, to_url, again in zip(*(batch.column(c).to_pylist() for c in names), strict=True)
        ]
        sizes = [n if m is None else len(m) for m, n in zip(members, batch.column("bytes").to_pylist(), strict=True)]
        columns = [batch.column("page_id"), batch.column("tie"), pa.array(sizes, pa.int64()), pa.array(members, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "tie", "bytes", "member"])


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id, tie, url, html: the order of the records, and what they are made of."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64("url", "html").alias("tie"), "url", "html")


def ledger(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, tie, bytes, member of every row of ``pages``: the size of its gzip member, and the
    member itself if it is a revisit, which needs no html. Written under ``path``."""
    keyed = _keyed(pages).withColumn("sha", F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256)))
    # Written first: a join of two plain shuffles can be split where a payload is very common.
    groups = staged(keyed.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("kept")), "payloads", f"{path}/_payloads")
    facts = keyed.mapInArrow(_measured, "page_id long, tie long, url string, sha binary, size long, digest string, bytes long")
    rows = facts.join(groups, "sha").select(
        "page_id",
        "tie",
        "url",
        "size",
        "digest",
        "bytes",
        F.col("kept.page_id").alias("to"),
        F.col("kept.url").alias("to_url"),
        (~F.col("page_id").eqNullSafe(F.col("kept.page_id")) & (F.col("size") >= revisit_from)).alias("again"),
    )
    return staged(rows.mapInArrow(_entered, "page_id long, tie long, bytes long, member binary"), "ledger", f"{path}/_ledger")


#: Shards of one archive set; the first record of each is sent to the tasks, 16 bytes a shard.
MAX_SHARDS = 4_000_000
#: Tasks that write; where there are more shards, each task writes several, one after the other.
MAX_TASKS = 20_000


def _order(page_id, tie) -> tuple:
    """A record's place among the others: those without a page_id come first."""
    return (page_id is not None, page_id or 0, tie)


def _shards(records: DataFrame, path: str, roll_bytes: int):
    """Where shards begin, and the records that are repeated over the end of one.

    The order of the first record of every shard but the first, and (shard, copies) by record for
    equal records of more than ``roll_bytes`` together: some bytes for each ``roll_bytes`` written.
    ``records`` has page_id, tie, bytes (of all copies) and n.
    """
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = records.repartitionByRange(parts, "page_id", "tie").withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "ranges", f"{path}/_ranges")
    sums = ranged.groupBy("part").agg(F.sum("bytes").alias("sum"))  # a row for each partition
    offsets = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("offset"))
    before = F.sum("bytes").over(Window.partitionBy("part").orderBy("page_id", "tie")) - F.col("bytes") + F.col("offset")
    placed = ranged.join(F.broadcast(offsets), "part").select("page_id", "tie", "bytes", "n", before.alias("before"))
    shards = placed.select(F.struct("page_id", "tie").alias("at"), F.floor(F.col("before") / roll_bytes).alias("shard"))
    firsts = shards.groupBy("shard").agg(F.min("at").alias("first")).where("shard > 0").limit(MAX_SHARDS + 1).collect()
    if len(firsts) > MAX_SHARDS:
        raise ValueError(f"over {MAX_SHARDS} shards; take a larger roll_bytes than {roll_bytes}")
    edges = sorted((*_order(*r["first"]), r["shard"]) for r in firsts)
    spread: dict = {}
    for r in placed.where((F.col("bytes") > roll_bytes) & (F.col("n") > 1)).collect():
        size, at, left = r["bytes"] // r["n"], r["before"], r["n"]
        while left:  # as many copies as begin in the shard
            shard = at // roll_bytes
            copies = min(left, -(-((shard + 1) * roll_bytes - at) // size))
            spread.setdefault(_order(r["page_id"], r["tie"]), []).append((shard, copies))
            at, left = at + copies * size, left - copies
    return edges, spread


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(path: str):
    def run(batches):
        import hashlib

        import pyarrow as pa

        files, base = _filesystem(path)
        info = _member(
            [
                ("WARC-Type", "warcinfo"),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, 'warcinfo')}>"),
                ("WARC-Date", DATE),
                ("Content-Type", "application/warc-fields"),
            ],
            b"format: WARC File Format 1.1\r\n",
        )
        state: dict = {}
        done: list[tuple] = []

        def commit():
            if state:
                state["out"].close()
                files.move(f"{base}/{state['temporary']}", f"{base}/{state['file']}")
                done.append(
                    (state["shard"], state["file"], state["n"], state["bytes"], state["sha"].hexdigest(), state["first"], state["last"])
                )
                state.clear()

        def put(data: bytes):
            state["out"].write(data)
            state["sha"].update(data)
            state["bytes"] += len(data)

        def begin(shard, page_id):
            commit()
            name = f"part-{shard:08d}.warc.gz"
            temporary = f"_temporary-{name}-{uuid.uuid4().hex}"
            out = files.open_output_stream(f"{base}/{temporary}", compression=None)
            state.update(shard=shard, file=name, temporary=temporary, out=out, n=0, bytes=0, first=page_id)
            state["sha"] = hashlib.sha256()
            put(info)

        awaited = None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "tie", "copies", "member", "url", "html")), strict=True)
            for shard, page_id, tie, copies, member, url, html in rows:
                if copies is None:  # a page; its ledger row came just before
                    if awaited is None or awaited[:3] != (shard, page_id, tie):
                        continue  # a revisit's, or one that another task has sent too
                    member, copies, awaited = response(page_id, url, html), awaited[3], None
                elif member is None:
                    awaited = (shard, page_id, tie, copies)
                    continue
                if state.get("shard") != shard:
                    begin(shard, page_id)
                for _ in range(copies):
                    put(member)
                state["n"] += copies
                state["last"] = page_id
        commit()
        columns = list(zip(*done, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["shard", "file", "n_records", "n_bytes", "sha256", "first_page", "last_page"]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], names=names)

    return run


def write(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``path``; the manifest.

    Of records with equal payloads of at least ``revisit_from`` bytes, that with the largest
    page_id is a response and the others are revisits of it; smaller payloads are all responses.
    A null html is an empty payload, a null url gets a urn. A null page_id sorts first, is
    smaller than any other, and never names the response unless all of its group are null. Rows
    that repeat a page_id are records of their own, and responses if it is the largest of their
    payload. A file may be longer than ``roll_bytes`` by its last record. Other columns are not read. An empty table
    gives an empty manifest.
    """
    files, base = _filesystem(path)
    files.create_dir(base, recursive=True)
    entries = ledger(pages, path, revisit_from)
    records = entries.groupBy("page_id", "tie").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    edges, spread = _shards(records, path, roll_bytes)
    one = entries.groupBy("page_id", "tie").agg(F.first("member").alias("member"), F.count(F.lit(1)).alias("copies"))
    placed = one.mapInArrow(_placer(edges, spread), "shard long, page_id long, tie long, copies long, member binary")
    form = "shard long, page_id long, tie long, url string, html string"
    keyed = _keyed(pages)
    pages = keyed.mapInArrow(_placer(edges, spread, "once"), form)
    if spread:  # such a record is brought together first, and goes from there to each of its shards
        several = keyed.mapInArrow(_placer(edges, spread, "spread"), form).groupBy("page_id", "tie")
        several = several.agg(F.first("url").alias("url"), F.first("html").alias("html"))
        pages = pages.unionByName(several.mapInArrow(_placer(edges, spread), form))
    none = lambda x, kind: F.lit(None).cast(kind).alias(x)
    dealt = placed.select("*", none("url", "string"), none("html", "string")).unionByName(
        pages.select("shard", "page_id", "tie", none("copies", "long"), none("member", "binary"), "url", "html")
    )
    last = max([0, *(x[-1] for x in edges), *(x[0] for own in spread.values() for x in own)])
    each = last // MAX_TASKS + 1
    dealt = dealt.repartitionById(last // each + 1, F.floor(F.col("shard") / each).cast("int"))
    dealt = dealt.sortWithinPartitions("shard", "page_id", "tie", F.desc_nulls_last("copies"))
    manifest = staged(dealt.mapInArrow(_writer(path), MANIFEST), "manifest", f"{path}/_manifest")
    for name in ("_payloads", "_ledger", "_ranges"):
        files.delete_dir(f"{base}/{name}")
    return manifest


def _placer(edges: list, spread: dict, part: str = ""):
    """Gives ledger rows and pages the shards they belong to, those of ``spread`` several. A task
    sends a page once, whatever its copies. Of the pages ``part`` may name those that aren't in
    ``spread`` (``once``) or are (``spread``, without their shards)."""

    def run(batches):
        import bisect

        import pyarrow as pa

        keys, numbers, sent = [x[:-1] for x in edges], [0, *(x[-1] for x in edges)], set()
        for batch in batches:
            rows, shards, copies = [], [], []
            entry = "copies" in batch.schema.names
            own = batch.column("copies").to_pylist() if entry else [1] * batch.num_rows
            for i, (page_id, tie, n) in enumerate(zip(batch.column("page_id").to_pylist(), batch.column("tie").to_pylist(), own, strict=True)):
                at = _order(page_id, tie)
                if part and (at in sent or (at in spread) != (part == "spread")):
                    continue
                if part:
                    sent.add(at)
                several = spread.get(at) if part != "spread" else [(-1, 1)]
                for shard, count in several or [(numbers[bisect.bisect_right(keys, at)], n)]:
                    rows.append(i)
                    shards.append(shard)
                    copies.append(count)
            taken = batch.take(pa.array(rows, pa.int64()))
            columns = {c: taken.column(c) for c in taken.schema.names} | {"shard": pa.array(shards, pa.int64())}
            if entry:
                columns["copies"] = pa.array(copies, pa.int64())
            names = ["shard", "page_id", "tie", "copies", "member"] if entry else ["shard", "page_id", "tie", "url", "html"]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return run


def parse(stream):
    """(fields, block) of each record in a gzip stream, a file object; bounded by one record."""
    import zlib

    held, unpack, raw = b"", zlib.decompressobj(31), b""
    while True:
        if not raw:
            raw = stream.read(READ_BYTES)
            if not raw:
                break
        held += unpack.decompress(raw)
        raw = b""
        if unpack.eof:
            raw, unpack = unpack.unused_data, zlib.decompressobj(31)
            head, _, rest = held.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            size = int(fields["Content-Length"])
            if rest[size:] != b"\r\n\r\n":
                raise ValueError("a record's length is wrong")
            yield fields, rest[:size]
            held = b""
    if held:
        raise ValueError("the archive ends inside a record")


def _reader(path: str):
    def run(batches):
        import pyarrow as pa

        files, base = _filesystem(path)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file"]

        def batch_of(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows = []
                with files.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for fields, block in parse(stream):
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        if fields["WARC-Block-Digest"] != f"sha1:{_base32(block)}":
                            raise ValueError(f"a block digest in {file} is wrong")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        page, to = fields["Page-ID"], fields.get("Refers-To-Page-ID")
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size = len(payload)
                            if digest != _base32(payload):
                                raise ValueError(f"a payload digest in {file} is wrong")
                        else:
                            size = int(fields["Payload-Length"])
                        uri = fields["WARC-Target-URI"]
                        rows.append((int(page) if page else None, size, digest, kind, int(to) if to else None, uri, file))
                        if len(rows) == 5000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return run


def read(manifest: DataFrame, path: str) -> DataFrame:
    """The records of the archives that ``manifest`` names, checked against their digests."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(parts, "file").mapInArrow(_reader(path), RECORD)
