"""Names, labels and locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, strip

# Types by extension, labels by route.
DOCUMENT_TYPES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "jp2": "image/jp2"}
#: Types of other images and files that documents hold, by extension, as registered with IANA.
OTHER_TYPES = {"svg": "image/svg+xml", "ico": "image/vnd.microsoft.icon", "heic": "image/heic", "heif": "image/heif", "avif": "image/avif", "emf": "image/emf", "wmf": "image/wmf", "pdf": "application/pdf", "json": "application/json", "xml": "text/xml", "html": "text/html", "htm": "text/html", "css": "text/css", "csv": "text/csv", "txt": "text/plain", "zip": "application/zip"}
UNKNOWN_TYPE = "application/octet-stream"
CAPTIONED = ["image/png", "image/jpeg", "image/webp", "image/gif"]
ROUTES = {"internal": "📚 Internal Knowledge", "web": "🌐 Web Search", "unavailable": "⚠️ No Reliable Source Found"}
OTHER_ROUTE = "🤖 AI Response"


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]+$", 0)


def file_type(path: Column) -> Column:
    """Extension in lower case, without the dot."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def document_mime(kind: Column) -> Column:
    return F.coalesce(lookup(DOCUMENT_TYPES, F.lower(kind)), F.lit("application/octet-stream"))


def extension(name: Column) -> Column:
    """An image's extension: lower case, no dots, jpg for jpeg and jpe, png for none."""
    bare = F.ltrim(F.lower(strip(name)), F.lit("."))
    return F.when(is_blank(bare), "png").when(bare.isin("jpeg", "jpe"), "jpg").otherwise(bare)


def image_mime(name: Column) -> Column:
    """Type of an image by its extension; a general one where the extension isn't known."""
    return F.coalesce(lookup({**OTHER_TYPES, **IMAGE_TYPES}, extension(name)), F.lit(UNKNOWN_TYPE))


def image_extension(name: Column, mime: Column) -> Column:
    """Extension of a file name, or where it has none that of its type; bin for types that aren't known."""
    by_type = {v: k for k, v in reversed([*IMAGE_TYPES.items(), *OTHER_TYPES.items()])}
    own = F.regexp_extract(file_name(name), r"[^.]\.([^.]+)$", 1)
    found = lookup(by_type, F.lower(strip(mime)))
    return F.when(own != "", extension(own)).when(found.isNotNull(), extension(found)).otherwise("bin")


def image_blob(source: Column, document_id: Column, index: Column, name: Column) -> Column:
    """Where a document's image is stored: a folder for the source and the document, then number and name."""
    stem = F.replace(strip(F.regexp_replace(file_name(source), r"\.[^.]*$", "")), F.lit(" "), F.lit("-"))
    stem = F.when(is_blank(stem), "document").otherwise(stem)
    named = F.when(is_blank(name), F.concat(F.lit("image-"), index.cast("string"))).otherwise(file_name(name))
    return F.concat_ws("/", F.lit("extracted-images"), stem, document_id, F.concat(F.format_string("%04d_", index), named))


def item_id(document_id: Column, index: Column) -> Column:
    return F.concat_ws(":", document_id, index.cast("string"))


def image_item_id(document_id: Column, index: Column) -> Column:
    return F.concat_ws(":", document_id, F.lit("image"), index.cast("string"))


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def error_message(message: Column, kind: Column, most: int = 4000) -> Column:
    """A failure's message, or its kind if there is none, cut to what the table holds."""
    return F.substring(F.when(is_blank(message), kind).otherwise(message), 1, most)


def location(page: Column, section: Column, first: Column, last: Column) -> Column:
    """Page, or section and paragraphs, or what there is of them; null if nothing is."""
    several = last.isNotNull() & (last != first)
    paragraphs = F.when(several, F.concat(F.lit("Paragraphs "), first.cast("string"), F.lit("–"), last.cast("string"))).when(first.isNotNull(), F.concat(F.lit("Paragraph "), first.cast("string")))
    titled = F.when(section != "", F.concat(F.lit("Section: "), section))
    both = F.concat(titled, F.lit(", "), paragraphs)
    return F.coalesce(F.concat(F.lit("Page "), page.cast("string")), both, titled, paragraphs)


def shortened(text: Column, longest: int, kept: int) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, kept), F.lit("..."))).otherwise(text)


def chat_title(question: Column) -> Column:
    return shortened(question, 35, 32)


def history_title(title: Column, active: Column) -> Column:
    return F.concat(F.when(active, "› ").otherwise(""), shortened(title, 30, 27))


def route_label(route: Column) -> Column:
    return F.coalesce(lookup(ROUTES, route), F.lit(OTHER_ROUTE))


def steps(answer: Column) -> Column:
    """In how many steps an answer is shown: word by word."""
    return F.size(F.split(answer, " "))


def beginning(answer: Column, step: Column) -> Column:
    """What is shown of an answer at a step, from 1."""
    return F.array_join(F.slice(F.split(answer, " "), F.lit(1), step), " ")


def progressive(answer: Column) -> Column:
    """All steps of an answer, which together are as long as its square: for short ones."""
    return F.transform(F.sequence(F.lit(1), steps(answer)), lambda i: beginning(answer, i))
