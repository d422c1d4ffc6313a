"""The column functions under SQL names, and elements as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from sitelake.functions.html import _flatten
from sitelake.functions.text import EMAIL, PHONE

_PATTERN = r"'^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?"
DEFINITIONS = {
    "site_slugify(t string) returns string":
        "coalesce(nullif(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-'), '^-+|-+$', ''), ''), 'section')",
    "site_to_cents(v string) returns bigint":
        "if(try_cast(v as decimal(34,14)) * 100 = floor(try_cast(v as decimal(34,14)) * 100), cast(try_cast(v as decimal(34,14)) * 100 as bigint), null)",
    "site_authority(u string) returns string": f"regexp_extract(u, {_PATTERN}//([^/?#]*)', 1)",
    "site_normalize_url(u string) returns string": (
        rf"concat(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)), '://', regexp_extract(u, {_PATTERN}//([^/?#]*)', 1), "
        rf"coalesce(nullif(regexp_replace(regexp_extract(u, {_PATTERN}(?://[^/?#]*)?([^?#]*)', 1), '/+$', ''), ''), '/'))"
    ),
    "site_first_email(t string) returns string": "regexp_extract(t, r'" + EMAIL + "', 0)",
    "site_first_phone(t string) returns string": "trim(regexp_extract(t, r'" + PHONE + "', 0))",
    "site_channel(c string, i int) returns double": "cast(conv(substring(c, 2 + 2 * i, 2), 16, 10) as double) / 255",
    "site_linear(v double) returns double": "if(v <= 0.03928, v / 12.92, pow((v + 0.055) / 1.055, 2.4))",
    "site_luminance(c string) returns double":
        "0.2126 * site_linear(site_channel(c, 0)) + 0.7152 * site_linear(site_channel(c, 1)) + 0.0722 * site_linear(site_channel(c, 2))",
    "site_contrast(a string, b string) returns double":
        "(greatest(site_luminance(a), site_luminance(b)) + 0.05) / (least(site_luminance(a), site_luminance(b)) + 0.05)",
}


@udtf(returnType="node_no int, end_no int, parent_no int, depth int, tag string, attrs map<string,string>, own_texts int")
class HtmlElements:
    """`LATERAL html_elements(html)`: one row per element."""

    def eval(self, html: str) -> Iterator[tuple]:
        for e in _flatten(html)["elements"]:
            yield e["node_no"], e["end_no"], e["parent_no"], e["depth"], e["tag"], dict(e["attrs"]), e["text_count"]


_FLAT = "page_id bigint, node_no int, end_no int, parent_no int, depth int, tag string, attrs map<string,string>, own_texts int"


@arrow_udtf(returnType=_FLAT)
class PageElements:
    """`page_elements(table(select page_id, html from ...), tags)`: a row per element of every page, a batch of pages at a time.

    `tags`, separated by blanks, keeps only elements of those names; null or empty keeps all. Null pages have no elements.
    """

    def eval(self, pages: pa.RecordBatch, tags: pa.Array | None = None) -> Iterator[pa.Table]:
        asked = tags[0].as_py() if tags is not None and len(tags) else None
        kept = set(asked.lower().split()) if asked else None
        columns: list[list] = [[] for _ in range(8)]
        for page_id, html in zip(pages.column("page_id").to_pylist(), pages.column("html").to_pylist()):
            for e in _flatten(html)["elements"] if html else ():
                if kept is None or e["tag"] in kept:
                    row = (page_id, e["node_no"], e["end_no"], e["parent_no"], e["depth"], e["tag"], list(dict(e["attrs"]).items()), e["text_count"])
                    for column, value in zip(columns, row):
                        column.append(value)
        kinds = [pa.int64(), *[pa.int32()] * 4, pa.string(), pa.map_(pa.string(), pa.string()), pa.int32()]
        names = [part.split()[0] for part in _FLAT.replace("map<string,string>", "map").split(", ")]
        yield pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def register_functions(spark: SparkSession) -> None:
    """Define the SQL functions of this session; all but the table function are plain SQL expressions."""
    for signature, body in DEFINITIONS.items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
    spark.udtf.register("html_elements", HtmlElements)
    spark.udtf.register("page_elements", PageElements)
