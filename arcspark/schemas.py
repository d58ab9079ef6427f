"""Spark types of the archive's records. Times are epoch milliseconds (long)."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, B, I, L, Y = T.StringType(), T.BinaryType(), T.IntegerType(), T.LongType(), T.ByteType()

BOOLEAN, LONGS, STRINGS = T.BooleanType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType())

HEADER = _struct(item_key=S, item_value=S)
HEADERS = T.ArrayType(HEADER)
RAW_RECORD = _struct(url=S, value=B, arc_file_name=S, arc_file_pos=L, arc_file_size=L)
ITEM = _struct(
    uri=S, host_ip=S, timestamp=L, mime_type=S, record_length=I, header_items=HEADERS, content=B,
    arc_file_name=S, arc_file_pos=L, flags=I, arc_file_size=L,
)
META_TAGS = _struct(robots_flags=Y, pragmas=Y, optional_refresh_url=S, optional_refresh_time=I, other_meta_tags=S)
URL_FINGERPRINT = _struct(domain_hash=L, url_hash=L, root_domain_hash=L)
CACHE_ITEM = _struct(url_fingerprint=L, url=S, source=Y, field_flags=I, headers=HEADERS, content=B, final_url=S)
ARCHIVE_INFO = _struct(arcfile_date=L, arcfile_index=I, arcfile_offset=I, compressed_size=I, segment_id=L, crawl_number=I)
URL_PARTS = _struct(
    valid=T.BooleanType(), scheme=S, username=S, password=S, host=S, port=S, path=S, query=S, ref=S, canonical=S,
)

CONTENT_TYPE = _struct(content_type=S, charset=S)
DECODED = _struct(text=S, charset=S)
GUNZIPPED = _struct(data=B, was_truncated=BOOLEAN)
DOM_NODE = _struct(node=I, depth=I, kind=S, name=S, text=S)

#: Bits of ITEM.flags and of META_TAGS.
TRUNCATED_IN_DOWNLOAD, TRUNCATED_IN_INFLATE = 1, 2
ROBOTS_ALL, ROBOTS_NO_INDEX, ROBOTS_NO_FOLLOW, ROBOTS_NO_ARCHIVE, PRAGMA_NO_CACHE = 1, 2, 4, 8, 1
