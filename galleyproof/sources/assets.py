"""Pictures that pages show: inline data, files of the package, addresses elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyproof.functions.text import css_length

REMOTE = r"^(https?://|#)"
INLINE = r"(?i)^data:image/"


def inline_data(src: Column) -> Column:
    """The bytes of a data address, base 64 or percent-coded; null if it is none or cannot be read.

    Characters outside the base 64 alphabet are passed over.
    """
    payload = F.regexp_replace(src, "^[^,]*,", "")
    is_base64 = F.regexp_extract(src, "^([^,]*),", 1).rlike("(?i);base64")
    coded = F.regexp_replace(payload, "[^A-Za-z0-9+/]", "")
    whole = F.rpad(coded, (F.ceil(F.length(coded) / 4) * 4).cast("int"), "=")
    plain = F.try_url_decode(F.replace(payload, F.lit("+"), F.lit("%2B"))).cast("binary")
    return F.when(src.rlike(INLINE) & F.contains(src, F.lit(",")), F.when(is_base64, F.try_to_binary(whole, F.lit("base64"))).otherwise(plain))


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def page_images(tree: DataFrame, packages: DataFrame, assets: DataFrame) -> DataFrame:
    """(page_id, idx, line, src, path, content): pictures of pages in document order.

    ``packages``: page_id, package. ``assets``: package, path, content; of equal base names
    the first by path counts. Inline pictures carry their bytes and the path ``data-uri``;
    pictures from elsewhere and those without a file have neither.
    """
    shown = tree.where("tag = 'img'").select("page_id", F.col("node_id").alias("idx"), "line", F.coalesce(F.element_at("attrs", "src"), F.lit("")).alias("src"))
    inline, local = F.col("src").rlike(INLINE), ~F.col("src").rlike(INLINE) & ~F.col("src").rlike(REMOTE) & (F.col("src") != "")
    named = shown.join(packages, "page_id", "left").withColumn("base", F.when(local, base_name(F.col("src"))))
    first = assets.groupBy("package", base_name(F.col("path")).alias("base")).agg(F.min_by(F.struct("path", "content"), "path").alias("a"))
    both = named.join(first, ["package", "base"], "left")
    path, content = F.when(inline, "data-uri").otherwise(F.col("a.path")), F.when(inline, inline_data(F.col("src"))).otherwise(F.col("a.content"))
    return both.select("page_id", "idx", "line", "src", path.alias("path"), content.alias("content"))


def declared_size(attrs: Column, style: Column) -> Column:
    """Width and height of a picture: its attributes, else its style."""
    side = lambda n: F.coalesce(css_length(F.element_at(attrs, n)), css_length(F.element_at(style, n)))
    return F.struct(side("width").alias("width"), side("height").alias("height"))
