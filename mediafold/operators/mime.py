"""Content type from leading bytes, else from metadata.

A signature is a list of ``(offset, hex bytes)`` parts that must all match.  The
signature list becomes one ``when`` chain over slices of the header, so
detection is a projection: no join, no shuffle, one pass over the files, and
it compares as many bytes as the longest signature needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafold.functions import text as X


def _brand(*names: str) -> list[list[tuple[int, str]]]:
    """ISO media files: ``ftyp`` at 4, the brand at 8."""
    return [[(4, "66747970"), (8, n.encode().hex().upper())] for n in names]


# Magic bytes, as (type, subtype, alternatives of [(offset, hex bytes), ...]); the first match wins.
SIGNATURES: list[tuple[str, str, list[list[tuple[int, str]]]]] = [
    ("image", "jpeg", [[(0, "FFD8FF")]]),
    ("image", "png", [[(0, "89504E470D0A1A0A")]]),
    ("image", "gif", [[(0, "47494638")]]),
    ("image", "webp", [[(0, "52494646"), (8, "57454250")]]),
    ("image", "x-canon-cr2", [[(0, "49492A00"), (8, "4352")], [(0, "4D4D002A"), (8, "4352")]]),
    ("image", "x-olympus-orf", [[(0, "4949524F")], [(0, "49495253")]]),
    ("image", "x-panasonic-rw2", [[(0, "49495500")]]),
    ("image", "x-fuji-raf", [[(0, "46554A4946494C4D")]]),
    ("image", "tiff", [[(0, "49492A00")], [(0, "4D4D002A")]]),
    ("image", "bmp", [[(0, "424D")]]),
    ("image", "x-icon", [[(0, "00000100")]]),
    ("image", "jxr", [[(0, "4949BC")]]),
    ("image", "vnd.adobe.photoshop", [[(0, "38425053")]]),
    ("image", "avif", _brand("avif", "avis")),
    ("image", "heif", _brand("heic", "heix", "hevc", "heim", "heis", "hevm", "hevs", "mif1", "msf1")),
    ("image", "x-canon-cr3", _brand("crx ")),
    ("video", "quicktime", _brand("qt  ")),
    ("video", "x-m4v", _brand("M4V", "M4VH", "M4VP")),
    ("video", "3gpp", _brand("3gp", "3g2", "3gg", "3ge", "3gs")),
    ("audio", "mp4", _brand("M4A", "M4B", "F4A", "F4B")),
    ("video", "mp4", [[(4, "66747970")]]),
    ("video", "quicktime", [[(4, "6D6F6F76")], [(4, "6D646174")], [(4, "77696465")], [(4, "66726565")]]),
    ("video", "x-msvideo", [[(0, "52494646"), (8, "415649")]]),
    ("audio", "x-wav", [[(0, "52494646"), (8, "57415645")]]),
    ("video", "mpeg", [[(0, "000001BA")], [(0, "000001B3")]]),
    ("video", "x-ms-wmv", [[(0, "3026B2758E66CF11A6D900AA0062CE6C")]]),
    ("video", "x-flv", [[(0, "464C5601")]]),
    ("audio", "midi", [[(0, "4D546864")]]),
    ("audio", "mpeg", [[(0, "494433")], [(0, "FFFB")], [(0, "FFF3")], [(0, "FFF2")]]),
    ("audio", "aac", [[(0, "FFF1")], [(0, "FFF9")]]),
    ("audio", "flac", [[(0, "664C6143")]]),
    ("audio", "ogg", [[(0, "4F676753")]]),
    ("audio", "amr", [[(0, "2321414D52")]]),
    ("audio", "x-aiff", [[(0, "464F524D"), (8, "41494646")]]),
    ("application", "pdf", [[(0, "25504446")]]),
    ("application", "zip", [[(0, "504B0304")]]),
    ("application", "x-tar", [[(257, "7573746172")]]),
    ("text", "html", [[(0, "3C21444F43545950452068746D6C")], [(0, "3C68746D6C")]]),
    ("text", "xml", [[(0, "3C3F786D6C")]]),
]
EBML = (0, "1A45DFA3")
# Matroska files name their document type in an element of their header (id, one byte of size, text), which other elements
# may precede; as many bytes are searched for it.
EBML_DOCTYPE, EBML_BYTES = "4282", 4096
EBML_TYPES = {"webm": ("video", "webm"), "matroska": ("video", "x-matroska")}


def header_bytes(signatures=None) -> int:
    """Bytes of a file that detection looks at: what the longest signature needs (and the Matroska header)."""
    reach = [off + len(h) // 2 for _, _, alts in (signatures or SIGNATURES) for parts in alts for off, h in parts]
    return max([EBML_BYTES if signatures is None else 64, *reach])


def _matches(content: Column, parts: list[tuple[int, str]]) -> Column:
    hit = F.lit(True)
    for off, h in parts:
        hit = hit & (F.substring(content, off + 1, len(h) // 2) == F.unhex(F.lit(h)))
    return hit


def signature_type(content: Column, signatures=None) -> Column:
    """struct(type, subtype) by leading bytes, NULL where no signature matches."""
    def kind(t, s):
        return F.struct(F.lit(t).alias("type"), F.lit(s).alias("subtype"))
    chain = F.when(F.lit(False), kind("", ""))
    for t, s, alts in signatures or SIGNATURES:
        hit = F.lit(False)
        for parts in alts:
            hit = hit | _matches(content, parts)
        chain = chain.when(hit, kind(t, s))
    if signatures is None:
        # One character a byte: an element is found where it starts, never across two halves of bytes.
        head = F.decode(F.substring(content, 1, EBML_BYTES), "ISO-8859-1")
        ebml = _matches(content, [EBML])
        mark = bytes.fromhex(EBML_DOCTYPE).decode("latin-1")
        for name, (t, s) in EBML_TYPES.items():
            chain = chain.when(ebml & head.contains(f"{mark}{chr(0x80 + len(name))}{name}"), kind(t, s))
        for name, (t, s) in reversed(EBML_TYPES.items()):  # headers without the element that name a type all the same
            chain = chain.when(ebml & head.contains(name), kind(t, s))
        chain = chain.when(ebml, kind(*EBML_TYPES["webm"]))
    return chain


def detect(files: DataFrame, content_col: str, signatures=None) -> DataFrame:
    """``files`` plus ``mimetype``/``mimesubtype`` from leading bytes (NULL when unknown); a projection."""
    staged = files.withColumn("_m", signature_type(F.col(content_col), signatures))
    return (staged.withColumn("mimetype", F.col("_m.type")).withColumn("mimesubtype", F.col("_m.subtype"))
            .drop("_m"))


def classify(files: DataFrame, content_col: str, metadata_mime_col: str, signatures=None) -> DataFrame:
    """D8 then G16: the signature decides; without one, the MIME type that the metadata states."""
    found = detect(files, content_col, signatures).withColumn("_s", X.mime_parts(F.col(metadata_mime_col)))
    known = F.col("mimetype").isNotNull()
    return (found.withColumn("mimesubtype", F.when(known, F.col("mimesubtype")).otherwise(F.col("_s.subtype")))
            .withColumn("mimetype", F.when(known, F.col("mimetype")).otherwise(F.col("_s.type"))).drop("_s"))
