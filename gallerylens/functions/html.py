"""Links, paragraphs and URLs of pages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text as X

ANCHOR = r'<a href="([^"]+)">(.*?)</a>'
#: The sizes of an image that are tried, in order.
SIZES = ["HD", "HalfHD", "Large", "Blog", "Portrait", "PinterestLarge", "PinterestSmall"]


def links(html: Column) -> Column:
    """Anchors as an array of (url, caption) in their order."""
    return F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("caption"))


def link_kind(url: Column) -> Column:
    return F.when(url.startswith("InfoboxHeader"), "infobox").when(url.startswith("File"), "thumb")


def link_file(url: Column) -> Column:
    """The file's name behind the prefix, with underscores for spaces."""
    name = F.when(url.startswith("InfoboxHeader"), F.substr(url, F.lit(17))).when(url.startswith("File"), F.substr(url, F.lit(8)))
    return F.replace(name, F.lit("%20"), F.lit("_"))


def paragraphs(html: Column) -> Column:
    """The texts of <p> elements: scripts, styles and comments removed, tags stripped, entities decoded, spaces squeezed."""
    bare = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    return F.transform(F.regexp_extract_all(bare, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: X.squeeze(X.html_unescape(F.regexp_replace(p, r"<[^>]*>", ""))))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def curid(url: Column) -> Column:
    """The page id at the end of a URL; null without one."""
    return F.nullif(F.regexp_extract(url, r".*curid=(\d+)$", 1), F.lit("")).try_cast("int")


def strip_modifier(url: Column) -> Column:
    """The address up to the first mark of a size; other exclamation marks stay."""
    return F.regexp_replace(url, rf"(?s)!(?:{'|'.join(SIZES)}).*$", "")


def candidates(url: Column) -> Column:
    """The addresses to try for an image, in order: each size, with what follows the last dot as extension."""
    clean = strip_modifier(url)
    extension = F.element_at(F.split(clean, r"\."), -1)
    return F.transform(F.array(*map(F.lit, SIZES)), lambda size: F.concat(clean, F.lit("!"), size, F.lit("."), extension))


def jpg_name(url: Column) -> Column:
    """The last segment up to its first dot, as .jpg."""
    return F.concat(F.split_part(last_segment(strip_modifier(url)), F.lit("."), F.lit(1)), F.lit(".jpg"))
