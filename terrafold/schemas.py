"""Explicit schemas of the element and change tables."""

META = "struct<version:int,timestamp:bigint,changeset:bigint,uid:bigint,user:string>"
TAGS = "array<struct<k:string,v:string>>"
MEMBERS = "array<struct<ref:bigint,type:string,role:string>>"
#: One row per object of an element file, in file order.
OBJECTS = f"pos bigint, type string, id bigint, version int, lon_i int, lat_i int, nodes array<bigint>, members {MEMBERS}, tags {TAGS}, meta {META}"
CHANGES = f"seq bigint, pos bigint, action string, type string, id bigint, version int, lon_i int, lat_i int, nodes array<bigint>, members {MEMBERS}, tags {TAGS}, meta {META}"


def arrow_schema(changes: bool = False):
    """:data:`OBJECTS` or :data:`CHANGES` for Arrow."""
    import pyarrow as pa

    tag = pa.struct([("k", pa.string()), ("v", pa.string())])
    member = pa.struct([("ref", pa.int64()), ("type", pa.string()), ("role", pa.string())])
    meta = pa.struct([("version", pa.int32()), ("timestamp", pa.int64()), ("changeset", pa.int64()), ("uid", pa.int64()), ("user", pa.string())])
    head = [("seq", pa.int64()), ("pos", pa.int64()), ("action", pa.string())] if changes else [("pos", pa.int64())]
    body = [("type", pa.string()), ("id", pa.int64()), ("version", pa.int32()), ("lon_i", pa.int32()), ("lat_i", pa.int32()), ("nodes", pa.list_(pa.int64())), ("members", pa.list_(member)), ("tags", pa.list_(tag)), ("meta", meta)]
    return pa.schema(head + body)


def record_batches(rows, changes: bool = False, size: int = 10_000):
    """Rows in the order of the schema as Arrow record batches."""
    from itertools import batched

    import pyarrow as pa

    schema = arrow_schema(changes)
    for part in batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
