"""Office files as rows and back, by the parts of their zip containers.

A document's content is one binary column (``spark.read.format("binaryFile")`` gives
it); reading and writing are narrow passes over Arrow batches, one file at a time.
Files that are no such container give no rows; characters that XML cannot hold are
left out of what is written.

Small files are many, and of one only its body is new: the other parts are packed once
for each kind of file, and relations that were read before are known by their bytes.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the file formats.
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_P = "http://schemas.openxmlformats.org/package/2006/relationships"
_T = "http://schemas.openxmlformats.org/package/2006/content-types"
_DOC = "application/vnd.openxmlformats-officedocument"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


#: Numbers as they are written plainly: no exponent, no leading zeros, no words such as nan.
_NUMBER = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?")
#: Characters that XML cannot hold.
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _safe(text: str | None) -> str:
    return escape(_NO_XML.sub("", text or ""))


#: Records of a zip file, which are the local header, the directory's entry and its end.
_LOCAL = struct.Struct("<4s5H3L2H")
_ENTRY = struct.Struct("<4s6H3L5H2L")
_END = struct.Struct("<4s4H2LH")
#: The first two without what reading skips: versions, times, attributes.
_LOCAL_READ = struct.Struct("<4s22x2H")
_ENTRY_READ = struct.Struct("<4s4x2H4x3L3H8xL")
#: Fixed value: from here on records need their long form.
_LONG = 0xFFFFFFFF
#: Flags of an entry that change nothing here: deflate's effort, sizes behind the data, UTF-8 names.
_PLAIN_FLAGS = 0x80E
#: Bytes up to which relations are kept to be known again, of the last ``_KEPT`` ones.
_KEPT_SIZE, _KEPT = 4096, 512

#: A part as it lies in its file: method, checksum, size, packed bytes.
_Packed = tuple[int, int, int, bytes]


def _places(content: bytes) -> dict[bytes, tuple[int, int, int, int, int]] | None:
    """``(method, checksum, packed size, size, place)`` by name, of a file without anything unusual; of others None."""
    try:
        sign, disk, first, here, total, size, at, comment = _END.unpack_from(content, len(content) - _END.size)
        end = at + size
        if sign != b"PK\5\6" or disk or first or here != total or comment or end + _END.size != len(content):
            return None
        found = {}
        while at < end:
            sign, flags, method, check, packed, size, named, extra, remark, place = _ENTRY_READ.unpack_from(content, at)
            at += _ENTRY_READ.size
            name = content[at : at + named]
            if sign != b"PK\1\2" or flags & ~_PLAIN_FLAGS or method & ~8 or _LONG in (packed, size, place) or not name.isascii() or b"\0" in name:
                return None
            found[name] = method, check, packed, size, place
            at += named + extra + remark
        return found if at == end else None
    except struct.error:
        return None


def _parsed(packed: _Packed | None) -> ElementTree.Element | None:
    if packed is None:
        return None
    method, check, size, data = packed
    try:
        text = zlib.decompressobj(-zlib.MAX_WBITS).decompress(data, max(size, 1)) if method else data
        return ElementTree.fromstring(text) if zlib.crc32(text) == check else None
    except (zlib.error, ElementTree.ParseError):
        return None


def _known(read: Callable) -> Callable:
    """``read(packed, ...)``, which small parts of the same bytes have done once."""
    kept = lru_cache(_KEPT)(read)
    return lambda packed, *rest: (kept if packed is not None and len(packed[3]) <= _KEPT_SIZE else read)(packed, *rest)


@_known
def _relations(packed: _Packed | None, folder: str) -> list[tuple[str, str, str]]:
    root = _parsed(packed)
    found = root.iter(f"{{{_P}}}Relationship") if root is not None else ()
    # A target is absolute or relative to the part's folder.
    return [(r.get("Id", ""), r.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join("/", folder, r.get("Target", ""))).lstrip("/")) for r in found]


@_known
def _first_sheet(packed: _Packed | None) -> str | None:
    """The relation of a workbook's first sheet."""
    root = _parsed(packed)
    first = next(root.iter(f"{{{_S}}}sheet"), None) if root is not None else None
    return None if first is None else first.get(f"{{{_R}}}id")


class _Container:
    """The parts of a file, found through its relations; of what is no container there are none."""

    def __init__(self, content: bytes | None) -> None:
        self.content, self.zip = bytes(content or b""), None
        self.places = _places(self.content)
        if self.places is None:
            try:
                self.zip = zipfile.ZipFile(io.BytesIO(self.content))
            except zipfile.BadZipFile:
                self.places = {}

    def packed(self, name: str) -> _Packed | None:
        if self.zip is not None:
            try:
                data = self.zip.read(name)
            except (KeyError, zipfile.BadZipFile, zlib.error, EOFError):
                return None
            return 0, zlib.crc32(data), len(data), data
        known = name.encode()
        if known not in self.places:
            return None
        method, check, packed, size, place = self.places[known]
        try:
            sign, named, extra = _LOCAL_READ.unpack_from(self.content, place)
        except struct.error:
            return None
        at = place + _LOCAL_READ.size
        own = self.content[at : at + named]
        at += named + extra
        return (method, check, size, self.content[at : at + packed]) if sign == b"PK\3\4" and own == known else None

    def part(self, name: str) -> ElementTree.Element | None:
        return _parsed(self.packed(name))

    def related(self, name: str) -> list[tuple[str, str, str]]:
        """``(id, last word of the type, part)`` of each relation of a part, or of the file (an empty name)."""
        folder, _, file = name.rpartition("/")
        return _relations(self.packed(f"{folder}/_rels/{file}.rels" if folder else f"_rels/{file}.rels"), folder)


def _of_type(relations: list[tuple[str, str, str]], kind: str, usual: str) -> str:
    return next((part for _, k, part in relations if k == kind), usual)


@cache
def _frame(main: str, kind: str, parts: tuple[tuple[str, str], ...]) -> tuple[bytes, bytes, int, str]:
    """The packed parts that all files of a kind share, with the relations and types that readers ask for; their directory and number, the body's name."""
    types = "".join(f'<Override PartName="/{n}" ContentType="{_DOC}.{t}+xml"/>' for n, t in (p.split("|") for p, _ in parts))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:

        def add(name: str, text: str) -> None:
            # An entry without a time: the same rows are the same bytes.
            z.writestr(zipfile.ZipInfo(name), _HEAD + text, zipfile.ZIP_DEFLATED)

        add("[Content_Types].xml", f'<Types xmlns="{_T}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>')
        add("_rels/.rels", f'<Relationships xmlns="{_P}"><Relationship Id="r1" Type="{_R}/officeDocument" Target="{main}"/></Relationships>')
        for name, text in parts:
            if text:
                add(name.split("|")[0], text)
        if kind:
            folder, file = main.rsplit("/", 1)
            add(f"{folder}/_rels/{file}.rels", f'<Relationships xmlns="{_P}">{kind}</Relationships>')
        count = len(z.namelist())
    return out.getvalue()[: z.start_dir], out.getvalue()[z.start_dir : -_END.size], count, next(n for n, text in parts if not text).split("|")[0]


def _container(main: str, kind: str, parts: tuple[tuple[str, str], ...], body: str) -> bytes:
    """A container of ``parts`` (name and text), whose one without a text has ``body``."""
    front, directory, count, name = _frame(main, kind, parts)
    text = (_HEAD + body).encode()
    if len(text) >= _LONG // 2:
        # Sizes of this kind have records of their own.
        out = io.BytesIO(front + directory + _END.pack(b"PK\5\6", 0, 0, count, count, len(directory), len(front), 0))
        out.seek(0, io.SEEK_END)
        with zipfile.ZipFile(out, "a", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
        return out.getvalue()
    data = zlib.compress(text, wbits=-zlib.MAX_WBITS)
    # Version 2.0, method 8, the first day that a zip file can hold.
    about = 0, 8, 0, 0x21, zlib.crc32(text), len(data), len(text), len(name), 0
    directory += _ENTRY.pack(b"PK\1\2", 20, 20, *about, 0, 0, 0, 0, len(front)) + name.encode()
    front += _LOCAL.pack(b"PK\3\4", 20, *about) + name.encode() + data
    return front + directory + _END.pack(b"PK\5\6", 0, 0, count + 1, count + 1, len(directory), len(front), 0)


# --- one file ---------------------------------------------------------------

_WORD = (("word/document.xml|wordprocessingml.document.main", ""),)
_SHEET = (
    ("xl/workbook.xml|spreadsheetml.sheet.main", f'<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>'),
    ("xl/worksheets/sheet1.xml|spreadsheetml.worksheet", ""),
)
_ROW, _CELL, _VALUE, _TEXT = (f"{{{_S}}}{tag}" for tag in ("row", "c", "v", "t"))
_SHEET_RELATION = f'<Relationship Id="r1" Type="{_R}/worksheet" Target="worksheets/sheet1.xml"/>'


def word_paragraphs(content: bytes | None) -> list[tuple[str, str]]:
    """``(style, text)`` of each paragraph; a paragraph without a style is ``Normal``."""
    file = _Container(content)
    root = file.part(_of_type(file.related(""), "officeDocument", "word/document.xml"))
    out = []
    for p in root.iter(f"{{{_W}}}p") if root is not None else ():
        style = p.find(f"{{{_W}}}pPr/{{{_W}}}pStyle")
        text = "".join(t.text or "" for t in p.iter(f"{{{_W}}}t"))
        out.append(("Normal" if style is None else style.get(f"{{{_W}}}val", "Normal"), text))
    return out


def word_file(paragraphs: list[tuple[str, str]]) -> bytes:
    body = "".join(
        f"<w:p><w:pPr><w:pStyle w:val={quoteattr(style)}/></w:pPr><w:r><w:t xml:space=\"preserve\">{_safe(text)}</w:t></w:r></w:p>" for style, text in paragraphs
    )
    return _container("word/document.xml", "", _WORD, f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>')


@lru_cache(_KEPT)
def _place(letters: str) -> int:
    """A column's number from 1 on, or 0."""
    place = 0
    for letter in filter(str.isalpha, letters):
        place = 26 * place + ord(letter.upper()) - 64
    return place


def sheet_rows(content: bytes | None) -> list[list[str | None]]:
    """The first sheet's rows as text, whatever its part is named; cells that are missing are null."""
    file = _Container(content)
    book = _of_type(file.related(""), "officeDocument", "xl/workbook.xml")
    relations, wanted = file.related(book), _first_sheet(file.packed(book))
    sheet = next((part for i, _, part in relations if i == wanted), "xl/worksheets/sheet1.xml")
    root, shared = file.part(sheet), file.part(_of_type(relations, "sharedStrings", "xl/sharedStrings.xml"))
    words = ["".join(t.text or "" for t in si.iter(_TEXT)) for si in shared.iter(f"{{{_S}}}si")] if shared is not None else []
    out = []
    for row in root.iter(_ROW) if root is not None else ():
        cells: list[str | None] = []
        for c in row.iter(_CELL):
            place = _place(c.get("r", "").rstrip("0123456789"))
            if place > len(cells) + 1:
                cells += [None] * (place - 1 - len(cells))
            kind = c.get("t")
            if kind == "inlineStr":
                cells.append("".join([t.text or "" for t in c.iter(_TEXT)]))
                continue
            value = c.find(_VALUE)
            if value is None:
                cells.append(None)
            else:
                cells.append(words[int(value.text)] if kind == "s" else value.text)
        out.append(cells)
    return out


@lru_cache(_KEPT)
def _column(n: int) -> str:
    return (_column(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)


def sheet_file(rows: list[list[str | None]]) -> bytes:
    """Plain decimal numbers that a numeric cell holds exactly become one, null an empty text, all else text."""

    def cell(at: str, value: str | None) -> str:
        if value is not None and _NUMBER.fullmatch(value) and sum(map(str.isdigit, value)) <= 15:
            return f'<c r="{at}"><v>{float(value):.15g}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{_safe(value)}</t></is></c>'

    body = "".join([f'<row r="{i}">{"".join([cell(f"{_column(j)}{i}", v) for j, v in enumerate(row)])}</row>' for i, row in enumerate(rows, 1)])
    return _container("xl/workbook.xml", _SHEET_RELATION, _SHEET, f'<worksheet xmlns="{_S}"><sheetData>{body}</sheetData></worksheet>')


# --- tables of files --------------------------------------------------------


def _values(column: pa.Array) -> list:
    """The column's values; those of lists are made at once, not as a scalar each."""
    if pa.types.is_list(column.type):
        inner = iter(_values(column.flatten()))
        return [None if n is None else list(islice(inner, n)) for n in column.value_lengths().to_pylist()]
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _mapped(df: DataFrame, key: str, column: str, read: Callable[[object], object], out: str, kind: pa.DataType, ddl: str) -> DataFrame:
    own = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([read(x) for x in _values(batch.column(1))], kind)], [key, out])

    return df.select(key, column).mapInArrow(run, f"{key} {own}, {out} {ddl}")


def _spread(df: DataFrame) -> DataFrame:
    """Rows over all cores: a file costs much time beside its few bytes, by which Spark would cut or join its tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def read_word(files: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """``(key, para_no, style, text)`` of Word files."""
    pair = pa.list_(pa.struct([("style", pa.string()), ("text", pa.string())]))
    read = lambda x: [{"style": s, "text": t} for s, t in word_paragraphs(x)]
    rows = _mapped(files, key, content, read, "p", pair, "array<struct<style:string,text:string>>")
    return rows.select(key, F.posexplode("p").alias("para_no", "x")).select(key, F.col("para_no").cast("long"), "x.style", "x.text")


def write_word(paras: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, content)``: a Word file of each document's paragraphs, in their order."""
    rows = paras.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("para_no", "style", "text"))).alias("p"))
    return _mapped(_spread(rows), key, "p", lambda p: word_file([(x["style"], x["text"]) for x in p]), "content", pa.binary(), "binary")


def read_sheets(files: DataFrame, key: str = "sheet_id", content: str = "content") -> DataFrame:
    """``(key, rows)``: the cells of each file's first sheet."""
    return _mapped(files, key, content, sheet_rows, "rows", pa.list_(pa.list_(pa.string())), "array<array<string>>")


def write_sheets(sheets: DataFrame, key: str = "sheet_id", rows: str = "rows") -> DataFrame:
    """``(key, content)``: a spreadsheet file of each row of tables; null rows are left out."""
    return _mapped(_spread(sheets.select(key, rows)), key, rows, lambda r: sheet_file([x for x in r or [] if x is not None]), "content", pa.binary(), "binary")


def append_rows(files: DataFrame, more: DataFrame, key: str = "sheet_id") -> DataFrame:
    """Spreadsheet files with further rows ``(key, rows)`` behind their own; a key without a file makes one.

    ``more`` may have ``headers``, a row that stands first: in a new file, and in place
    of the first row of a file that has no more than one.
    """
    table = "array<array<string>>"
    empty = F.array().cast(table)
    head = F.when(F.size("headers") > 0, F.array("headers")) if "headers" in more.columns else F.lit(None).cast(table)
    own = read_sheets(files, key).withColumnRenamed("rows", "_old")
    joined = own.join(more.select(key, "rows", head.alias("_head")), key, "full")
    old = F.coalesce("_old", empty)
    first = F.when(F.col("_head").isNotNull() & (F.size(old) <= 1), F.col("_head")).otherwise(old)
    return write_sheets(joined.select(key, F.concat(first, F.coalesce("rows", empty)).alias("rows")), key)
