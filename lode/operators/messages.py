"""Chat messages: translation of roles and content blocks, and reading of responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import data_uri

BLOCKS = "array<struct<type:string,text:string,url:string>>"


def translate_blocks(blocks: Column) -> Column:
    """Text blocks pass; images become base64 or URL sources; other kinds and unreadable data URIs go."""
    kind = "struct<type:string,text:string,source:string,media_type:string,data:string,url:string>"

    def one(b: Column) -> Column:
        uri, none = data_uri(b["url"]), F.lit(None).cast("string")
        field = lambda t, text, s, m, d, u: F.struct(F.lit(t).alias("type"), text.alias("text"), F.lit(s).cast("string").alias("source"), m.alias("media_type"), d.alias("data"), u.alias("url"))
        return (
            F.when(b["type"] == "text", field("text", F.coalesce(b["text"], F.lit("")), None, none, none, none))
            .when((b["type"] == "image_url") & b["url"].startswith("data:"), F.when(uri.isNotNull(), field("image", none, "base64", uri["media_type"], uri["data"], none)))
            .when((b["type"] == "image_url") & (b["url"] != ""), field("image", none, "url", none, none, b["url"]))
        )

    return F.filter(F.transform(blocks, one), lambda x: x.isNotNull()).cast(f"array<{kind}>")


def translate(role: Column, content: Column) -> Column:
    """struct(role, content): role defaults to user, content to the empty string."""
    return F.struct(F.coalesce(role, F.lit("user")).alias("role"), F.coalesce(content, F.lit("")).alias("content"))


def first_text(content: Column) -> Column:
    """The first text of a response's content blocks, or the empty string."""
    return F.coalesce(F.try_element_at(content, F.lit(1))["text"], F.lit(""))
