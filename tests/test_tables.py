import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from foliant.functions import names
from foliant.operators import chat, tables
from foliant.plans.ingest import ingest, open_store, preview
from foliant.sources import files
from foliant.sources.pdf import pdf_images, pdf_units
from foliant.streaming.ingest import watch

NOW = "2024-06-01 00:00:00"


def document(spark, *rows):
    return spark.createDataFrame([{"source_container": c, "source_blob_name": b, "file_name": b, "file_type": t, "mime_type": "m", "file_size_bytes": 1, "checksum": s, "metadata": "{}"} for c, b, t, s in rows])


def test_upsert_keeps_id_and_creation(spark):
    empty = spark.createDataFrame([], tables.DOCUMENTS)
    first = tables.upsert_documents(empty, document(spark, ("c", "a", "pdf", "1"), ("c", "b", "pdf", "1")), F.lit("2024-01-01").cast("timestamp"))
    marked = tables.mark(first, first.select("id", F.lit("failed").alias("status"), F.repeat(F.lit("x"), 5000).alias("error")), F.lit(NOW).cast("timestamp"))
    assert {len(r["processing_error"]) for r in marked.collect()} == {4000}
    both = document(spark, ("c", "a", "docx", "2"), ("c", "a", "docx", "3"), ("d", "a", "pdf", "1")).withColumn("v", F.col("checksum"))
    again = {(r["source_container"], r["source_blob_name"]): r for r in tables.upsert_documents(marked, both, F.lit(NOW).cast("timestamp"), F.col("v")).collect()}
    old = {r["source_blob_name"]: r for r in marked.collect()}
    a = again["c", "a"]
    assert a["id"] == old["a"]["id"] and a["created_at"] == old["a"]["created_at"] and a["checksum"] == "3" and a["processing_status"] == "processing" and a["processing_error"] is None
    assert again["c", "b"]["processing_status"] == "failed" and len(again) == 3 and again["d", "a"]["id"] not in {r["id"] for r in old.values()}


def test_mark_and_unknown(spark):
    docs = tables.upsert_documents(spark.createDataFrame([], tables.DOCUMENTS), document(spark, ("c", "a", "pdf", "1")), F.lit(NOW).cast("timestamp"))
    outcomes = docs.select("id", F.lit("completed").alias("status"), F.lit("ignored").alias("error")).union(spark.createDataFrame([("none", "failed", "x")], "id string, status string, error string"))
    row = tables.mark(docs, outcomes, F.lit(NOW).cast("timestamp")).first()
    assert row["processing_status"] == "completed" and row["processing_error"] is None
    assert [r["id"] for r in tables.unknown(outcomes, docs).collect()] == ["none"]


def test_children(spark):
    now = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("x", 0)], "document_id string, n int")
    new = spark.createDataFrame([("a", 9)], "document_id string, n int")
    replaced = spark.createDataFrame([("a",), ("b",)], "document_id string")
    assert {tuple(r) for r in tables.replace_children(now, new, replaced).collect()} == {("a", 9), ("x", 0)}
    docs = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {r[0] for r in tables.orphans(now, docs).collect()} == {"x"}
    assert {r[0] for r in tables.without(now, docs.where("id = 'a'")).collect()} == {"b", "x"}


def test_constraints(spark):
    rows = spark.createDataFrame([("1", "pdf", "pending", 1), ("2", "txt", "lost", -1), ("3", None, None, None)], "id string, file_type string, processing_status string, file_size_bytes long")
    assert {r["id"]: r["violated"] for r in tables.violations(rows, "documents").collect()} == {"2": ["file_type", "processing_status", "file_size"]}
    chunks = spark.createDataFrame([(0, 1, "x", ["a"], "{}"), (-1, -1, " ", None, "[]"), (1, None, "y", [], "oops")], "chunk_index int, token_count int, content string, section_path array<string>, metadata string")
    found = {r["chunk_index"]: r["violated"] for r in tables.violations(chunks, "document_chunks").collect()}
    assert found[-1] == ["chunk_index", "token_count", "content", "section_path", "metadata"] and 0 not in found
    images = spark.createDataFrame([(0, None, 0, 1, "{}")], "image_index int, page_number int, width int, height int, metadata string")
    assert tables.violations(images, "document_images").first()["violated"] == ["width"]
    keys = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("b", None)], "document_id string, chunk_index int")
    assert [tuple(r) for r in tables.duplicates(keys, ("document_id", "chunk_index")).collect()] == [("a", 1, 2)]
    assert tables.missing_columns(keys, "document_id string, chunk_index long") == ["chunk_index"] and tables.missing_tables(spark, ["nothing"]) == ["nothing"]
    assert tables.defaults(spark.createDataFrame([(None, None)], "processing_status string, metadata string"), F.current_timestamp()).first()[:2] == ("pending", "{}")


def test_pairs(spark):
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "document_id string, chunk_index int")
    vectors = spark.createDataFrame([("a:0",), ("b:0",), ("b:0",), ("c:0",)], "item_id string")
    assert {tuple(r) for r in tables.mispaired(chunks, vectors).collect()} == {("a:1", True, False), ("b:0", True, True), ("c:0", False, True)}


def test_chats(spark):
    rows = [("u", 1, "ask", "a", "first?"), ("u", 2, "ask", "a", "then"), ("u", 3, "ask", "b", "x" * 40), ("u", 4, "clear", "a", None), ("u", 5, "ask", "a", "anew"), ("u", 6, "ask", "c", "gone"), ("u", 7, "delete", "c", None), ("u", 8, "ask", "d", "q"), ("u", 9, "clear", "d", None)]
    found = {r["chat"]: (r["messages"], r["title"]) for r in chat.after(spark.createDataFrame(rows, "user_id string, seq int, action string, chat string, text string")).collect()}
    assert found == {"a": (1, "anew"), "b": (1, "x" * 32 + "..."), "d": (0, None)}


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(*paragraphs, image=False):
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>')
        if image:
            kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"
            rels = "".join(f'<Relationship Id="r{i}" Type="{kind}" Target="media/a.jpeg"/>' for i in range(2)) + f'<Relationship Id="x" Type="{kind}" Target="http://x/y.png" TargetMode="External"/>'
            z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
            z.writestr("word/media/a.jpeg", b"\xff\xd8data")
    return out.getvalue()


def pdf(packed=True, extra=b""):
    """Two pages: the first has no text, the second has words in three fonts, in two streams, and a JPEG image."""
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <00DC> <0002> <0062> endbfchar 1 beginbfrange <0010> <0012> <0065> endbfrange"
    one = b"BT /F1 12 Tf 50 700 Td (Safe \\(work\\) ) Tj [(with ) -20 (glo) 30 (ves) -300 (on)] TJ 0 -14 Td (second\\040line) Tj ET"
    two = b"BI /W 1 ID xx EI BT /F2 9 Tf 1 0 0 1 50 600 Tm <000100020010> Tj /F3 9 Tf 1 0 0 1 90 600 Tm (A\x80) Tj T* (end \\344) Tj ET % comment" + b"\nBT /F1 9 Tf 0 -9 Td (" + b"More words for a chunk of fair size. " * 4 + b") Tj ET"
    squeeze = lambda b: zlib.compress(b) if packed else b
    kind = b"/Filter /FlateDecode " if packed else b""
    stream = lambda about, b: b"<< " + about + b" /Length %d >>\nstream\n" % len(b) + b + b"\nendstream"
    parts = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 7 0 R /F2 8 0 R /F3 9 0 R >> /XObject << /I 11 0 R /J 11 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Resources << >> >>", 4: b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R 6 0 R] >>", 5: stream(kind, squeeze(one)), 6: stream(kind, squeeze(two)),
        10: stream(kind, squeeze(cmap)), 11: stream(b"/Type /XObject /Subtype /Image /Width 64 /Height 48 /Filter /DCTDecode", b"\xff\xd8jpeg"),
    }
    fonts = {7: b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>", 8: b"<< /Type /Font /Subtype /Type0 /ToUnicode 10 0 R >>", 9: b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [ 128 /Udieresis ] >> >>"}
    if packed:  # the fonts in an object stream
        offsets, body = [], b""
        for n, b in fonts.items():
            offsets.append(b"%d %d" % (n, len(body)))
            body += b + b" "
        head = b" ".join(offsets) + b" "
        parts[12] = stream(b"/Type /ObjStm /N 3 /First %d " % len(head) + kind, squeeze(head + body))
    else:
        parts |= fonts
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % n + b + b"\nendobj\n" for n, b in parts.items()) + b"trailer << /Root 1 0 R " + extra + b">>"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf(packed):
    (unit,) = pdf_units(pdf(packed))
    assert unit["page_number"] == 2
    lines = unit["text"].split("\n")
    assert lines[:4] == ["Safe (work) with gloves on", "second line", "Übe AÜ", "end ä"] and lines[4].startswith("More words")
    (image,) = pdf_images(pdf(packed))
    assert image["file_name"] == "page-2-image-0.jpg" and image["content"] == b"\xff\xd8jpeg" and (image["width"], image["height"]) == (64, 48)
    with pytest.raises(ValueError):
        pdf_units(b"no pdf")
    with pytest.raises(ValueError):
        pdf_units(pdf(packed, b"/Encrypt 1 0 R "))


def test_pdf_images_of_samples():
    """Samples become PNG files that hold the same rows; a predictor's rows are taken over."""
    rgb, gray, cmyk = bytes(range(24)), b"\xaa\x55", bytes([0, 0, 0, 0, 255, 255, 0, 0, 0, 0, 0, 255])
    filtered = b"\2" + bytes(12) + b"\1" + bytes(range(12))
    kinds = [
        (b"/ColorSpace /DeviceRGB /BitsPerComponent 8 /Width 4 /Height 2", rgb, (2, b"\0" + rgb[:12] + b"\0" + rgb[12:])),
        (b"/ColorSpace [/ICCBased 9 0 R] /BitsPerComponent 8 /Width 4 /Height 2 /DecodeParms << /Predictor 15 /Colors 3 /Columns 4 >>", filtered, (2, filtered)),
        (b"/ImageMask true /Width 8 /Height 2", gray, (0, b"\0\xaa\0\x55")),
        (b"/ColorSpace [/Indexed /DeviceRGB 1 <0000FF00FF00>] /BitsPerComponent 1 /Width 8 /Height 2", gray, (3, b"\0\xaa\0\x55")),
        (b"/ColorSpace /DeviceCMYK /BitsPerComponent 8 /Width 3 /Height 1", cmyk, (2, b"\0" + bytes([255, 255, 255, 0, 0, 255, 0, 0, 0]))),
        (b"/ColorSpace /Pattern /BitsPerComponent 8 /Width 3 /Height 1", cmyk, None),
        (b"/ColorSpace /DeviceGray /BitsPerComponent 1 /Width 8 /Height 2 /Filter /CCITTFaxDecode", gray, None),
    ]
    for about, data, expected in kinds:
        packed = data if b"Filter" in about else zlib.compress(data)
        more = b"" if b"Filter" in about else b" /Filter /FlateDecode"
        body = b"<< /Type /XObject /Subtype /Image " + about + more + b" /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream"
        parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Resources << /XObject << /I 4 0 R >> >> >>", body]
        file = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % n + b + b"\nendobj\n" for n, b in enumerate(parts, 1)) + b"9 0 obj\n<< /N 3 /Length 0 >>\nstream\n\nendstream\nendobj\ntrailer << /Root 1 0 R >>"
        found = pdf_images(file)
        assert len(found) == (expected is not None)
        if expected:
            png, (kind, rows) = found[0]["content"], expected
            assert found[0]["file_name"] == "page-1-image-0.png" and files._size(png) == (found[0]["width"], found[0]["height"]) and png[25] == kind
            at = png.index(b"IDAT")
            assert zlib.decompress(png[at + 4 : at + 4 + int.from_bytes(png[at - 4 : at], "big")]) == rows and (b"PLTE" in png) == (kind == 3)


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "blobs"
    (at / "sub").mkdir(parents=True)
    (at / "good.docx").write_bytes(docx(("H1", "Safety"), ("", ""), ("", "Workers must wear gloves. " * 10), image=True))
    (at / "sub" / "bad.DOCX").write_bytes(b"no zip")
    (at / "empty.docx").write_bytes(docx(("", " ")))
    (at / "scan.pdf").write_bytes(pdf())
    (at / "notes.txt").write_bytes(b"not a document")
    return str(at)


def test_parsing(spark, folder):
    found = files.blobs(spark, folder)
    assert {r["name"] for r in found.collect()} == {"good.docx", "sub/bad.DOCX", "empty.docx", "scan.pdf", "notes.txt"}
    docs = files.documents(found)
    assert {r["file_type"] for r in docs.collect()} == {"docx", "pdf"}
    units = {(r["path"].rsplit("/", 1)[-1], r["paragraph_number"]): r for r in preview(found).collect()}
    assert units["good.docx", 1]["style"] == "Heading 1" and units["good.docx", 3]["section"] == "Safety"
    assert "zip" in units["bad.DOCX", None]["error"].lower() and units["scan.pdf", None]["error"] is None and units["scan.pdf", None]["page_number"] == 2
    images = files.images(docs.where("name = 'good.docx'")).collect()
    assert [(r["file_name"], r["mime_type"], r["image_index"]) for r in images] == [("a.jpeg", "image/jpeg", 0)]
    with pytest.raises(ValueError):
        files.blobs(spark, " ")
    many = spark.createDataFrame([("p", 1, 5, 0), ("p", 1, 5, 1), ("p", 2, 5, 2)], "path string, page_number int, xref int, place int")
    assert [r["image_index"] for r in files.distinct_images(many).orderBy("place").collect()] == [0, 1]


@pytest.fixture
def model():
    return lambda texts: ([[float(len(t)), 1.0] for t in texts], len(texts))


def test_ingest(spark, folder, tmp_path, model):
    store, now = open_store(spark, str(tmp_path / "store"), 4), F.lit(NOW).cast("timestamp")
    pdf = {"pdf": lambda content: [{"text": "Page text of a scan. " * 8, "page_number": 1}]}
    run = lambda: {r["document_id"]: (r["status"], r["error"]) for r in ingest(store, files.blobs(spark, folder), F.lit("c"), model, "m", 2, now, parsers=pdf).collect()}
    first = run()
    docs = {r["source_blob_name"]: r for r in store.read("documents").collect()}
    assert {n: r["processing_status"] for n, r in docs.items()} == {"good.docx": "completed", "scan.pdf": "completed", "empty.docx": "failed", "sub/bad.DOCX": "failed"}
    assert docs["empty.docx"]["processing_error"] == "the document has no text"
    chunks = store.read("document_chunks").orderBy("content").collect()
    assert [r["section_path"] for r in chunks] == [[], ["Safety"]] and all(len(r["embedding"]) == 2 for r in chunks)
    assert run() == first and store.read("document_chunks").count() == 2
    assert len(store.versions()) == 2


def test_ingest_with_images(spark, folder, tmp_path, model):
    store, now = open_store(spark, str(tmp_path / "store"), 4), F.lit(NOW).cast("timestamp")
    run = lambda captioner: {r["document_id"]: r["error"] for r in ingest(store, files.blobs(spark, folder).where("name = 'good.docx'"), F.lit("c"), model, "m", 2, now, captioner=captioner).collect()}
    assert list(run(lambda data, mime: f"{mime} of {len(data)} bytes").values()) == [None]
    image = store.read("document_images").first()
    assert image["caption"] == "image/jpeg of 6 bytes" and image["caption_embedding"] == [21.0, 1.0] and image["image_blob_name"].startswith("extracted-images/good/") and image["image_blob_name"].endswith("/0000_a.jpeg")
    assert bytes(store.read("image_blobs").first()["content"]) == b"\xff\xd8data"
    assert list(run(lambda data, mime: "").values()) == ["the model gave no caption"]
    assert store.read("documents").first()["processing_status"] == "failed" and store.read("document_images").count() == 1


def test_image_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (48).to_bytes(2, "big") + (64).to_bytes(2, "big") + b"\0" * 10
    gif = b"GIF89a" + (3).to_bytes(2, "little") + (4).to_bytes(2, "little")
    rows = spark.createDataFrame([("d", 0, png), ("d", 1, jpeg), ("d", 2, gif), ("d", 3, b"x"), ("d", 4, None)], "path string, image_index int, content binary")
    sized = rows.withColumn("s", files.image_size(F.col("content"))).select("path", "image_index", "s.*")
    assert [tuple(r)[2:] for r in sized.orderBy("image_index").collect()] == [(640, 480), (64, 48), (3, 4), (None, None), (None, None)]
    assert files.largest(sized).first()["image_index"] == 0
    names = spark.createDataFrame([(" a/b.pdf ",), ("a/..",), ("a/",), (" ",)], "n string")
    assert [r[0] for r in names.select(files.blob_name(F.col("n"))).collect()] == ["a/b.pdf", None, None, None]
    assert files.mock_chunks(spark, "What about PPE?", ["ppe"], [(1,), (2,)], "i int", 1).count() == 1 and files.mock_chunks(spark, "no", ["ppe"], [(1,)], "i int", 1).count() == 0


def test_stream(spark, folder, tmp_path, model):
    at = str(tmp_path / "store")
    query = watch(spark, folder, at, str(tmp_path / "checkpoint"), model, "m", 2, files_a_batch=2, bucket_rows=4)
    query.awaitTermination()
    states = {r["source_blob_name"]: r["processing_status"] for r in open_store(spark, at).read("documents").collect()}
    assert states == {"good.docx": "completed", "scan.pdf": "completed", "empty.docx": "failed", "sub/bad.DOCX": "failed"}


def test_counts_and_types(spark):
    units = spark.createDataFrame([("a", 1, 1), ("a", 2, None), ("b", None, 3)], "path string, page_number int, paragraph_number int")
    found = spark.createDataFrame([("a",), ("a",)], "path string")
    assert sorted(map(tuple, files.counts(units, found).collect())) == [("a", 2, 1, 2), ("b", 0, 1, 0)]
    rows = [(".JPEG", "image/jpeg"), ("svg", "image/svg+xml"), ("jp2", "image/jp2"), ("xyz", "application/octet-stream"), (None, "image/png")]
    got = spark.createDataFrame(rows, "e string, m string").select(names.image_mime(F.col("e")), "m").collect()
    assert all(a == b for a, b in got)
    cases = [("a/b.JPE", "image/gif", "jpg"), ("noext", "image/tiff", "tif"), ("noext", "IMAGE/JPEG ", "jpg"), ("x", "what/ever", "bin"), ("x", None, "bin"), (None, "image/png", "png"), (".hidden", "image/webp", "webp")]
    got = spark.createDataFrame(cases, "n string, m string, x string").select(names.image_extension(F.col("n"), F.col("m")), "x").collect()
    assert all(a == b for a, b in got)


def test_signed_links(spark):
    import hashlib
    import hmac

    at = lambda s: F.lit(s).cast("timestamp")
    row = spark.range(1).select(files.read_url(F.lit("c"), F.lit("a/ü b.pdf"), "key", at("2024-01-01 00:00:10")).alias("u"), files.read_url(F.lit("c"), F.lit(" "), "key", at("2024-01-01")).alias("none"))
    url, none = row.first()
    place, until = "c/a/ü b.pdf", "1704067210"
    assert none is None and url == f"{place}?expires={until}&signature=" + hmac.new(b"key", f"{place}\n{until}".encode(), hashlib.sha256).hexdigest()
    now, late = at("2024-01-01 00:00:09"), at("2024-01-01 00:00:10")
    check = row.select(files.valid_url(F.col("u"), "key", now), files.valid_url(F.col("u"), "key", late), files.valid_url(F.col("u"), "k" * 80, now), files.valid_url(F.concat(F.lit("x"), "u"), "key", now), files.valid_url(F.col("none"), "key", now))
    assert list(check.first()) == [True, False, False, False, False]


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc'), (2, None)], "id int, t string")
    files.write_csv(df, str(tmp_path / "c"))
    assert {tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), "id int, t string").collect()} == {(1, 'a "q", b\nc'), (2, None)}
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
