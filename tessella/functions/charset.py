"""Character sets of captured bodies: detection from header and first bytes, and decoding."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

# The web's names of character sets with their labels beside the name itself; repeated forms are made by rule.
_LABELS = {
    "utf-8": "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf8 x-unicode20utf8", "ibm866": "866 cp866 csibm866",
    "iso-8859-2": "csisolatin2 iso-ir-101 iso_8859-2:1987 l2 latin2", "iso-8859-3": "csisolatin3 iso-ir-109 iso_8859-3:1988 l3 latin3", "iso-8859-4": "csisolatin4 iso-ir-110 iso_8859-4:1988 l4 latin4",
    "iso-8859-5": "csisolatincyrillic cyrillic iso-ir-144 iso_8859-5:1988", "iso-8859-6": "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i iso-ir-127 iso_8859-6:1987",
    "iso-8859-7": "csisolatingreek ecma-118 elot_928 greek greek8 iso-ir-126 iso_8859-7:1987 sun_eu_greek", "iso-8859-8": "csiso88598e csisolatinhebrew hebrew iso-8859-8-e iso-ir-138 iso_8859-8:1988 visual", "iso-8859-8-i": "csiso88598i logical",
    "iso-8859-10": "csisolatin6 iso-ir-157 l6 latin6", "iso-8859-13": "", "iso-8859-14": "", "iso-8859-15": "csisolatin9 l9", "iso-8859-16": "", "koi8-r": "cskoi8r koi koi8 koi8_r", "koi8-u": "koi8-ru",
    "macintosh": "csmacintosh mac x-mac-roman", "windows-874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620",
    "windows-1252": "ansi_x3.4-1968 ascii cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii",
    "windows-1254": "csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5", "x-mac-cyrillic": "x-mac-ukrainian",
    "gbk": "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 iso-ir-58 x-gbk", "gb18030": "", "big5": "big5-hkscs cn-big5 csbig5 x-x-big5", "euc-jp": "cseucpkdfmtjapanese x-euc-jp", "iso-2022-jp": "csiso2022jp",
    "shift_jis": "csshiftjis ms932 ms_kanji shift-jis sjis windows-31j x-sjis", "euc-kr": "cseuckr csksc56011987 iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "replacement": "csiso2022kr hz-gb-2312 iso-2022-cn iso-2022-cn-ext iso-2022-kr", "utf-16be": "unicodefffe", "utf-16le": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16", "x-user-defined": "",
}
# Python's codecs where they have another name.
CODECS = {
    "gbk": "gb18030", "shift_jis": "cp932", "euc-kr": "cp949", "big5": "big5hkscs", "euc-jp": "euc_jp", "ibm866": "cp866", "iso-8859-8-i": "iso-8859-8", "macintosh": "mac_roman", "x-mac-cyrillic": "mac_cyrillic",
    "windows-874": "cp874", **{f"windows-125{k}": f"cp125{k}" for k in range(9)},
}
#: Byte order marks, which win over any label.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16be"), (b"\xff\xfe", "utf-16le"))


def _by_rule() -> dict[str, str]:
    out = {}
    for name in [*_LABELS, *(f"windows-125{k}" for k in range(9))]:
        forms = [name, *_LABELS.get(name, "").split()]
        if name.startswith("iso-8859-") and name[9:].isdigit() and name != "iso-8859-16":
            n = name[9:]
            forms += [f"iso8859-{n}", f"iso8859{n}", *([f"iso_8859-{n}"] if int(n) < 10 or n == "15" else [])]
        if name.startswith("windows-125"):
            forms += [f"cp{name[8:]}", f"x-cp{name[8:]}"]
        out |= dict.fromkeys(forms, name)
    return out


#: Every label with the name of its character set.
LABELS = _by_rule()


def canonical(label: str | None) -> str | None:
    """The name of a label's character set; null if there is none."""
    return LABELS.get(label.strip(" \t\n\f\r").lower()) if label else None


def label_table(spark: SparkSession) -> DataFrame:
    """(label, encoding) of all labels: some 220 rows, whatever they are joined to."""
    return spark.createDataFrame(sorted(LABELS.items()), "label string, encoding string")


def with_encoding(rows: DataFrame, label: str, labels: DataFrame | None = None) -> DataFrame:
    """rows with the encoding that a column's label names, null for none: a join with the labels, or with other ones."""
    known = (label_table(rows.sparkSession) if labels is None else labels).select(F.col("label").alias("__label"), "encoding")
    return rows.drop("encoding").join(F.broadcast(known), F.lower(F.btrim(F.col(label), F.lit(" \t\n\f\r"))) == F.col("__label"), "left").drop("__label")


@pandas_udf(StringType())
def encoding_for(label: pd.Series) -> pd.Series:
    return label.map(canonical, na_action="ignore")


def declared_in_header(content_type: Column) -> Column:
    return F.nullif(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([^;\"'\s]+)", 1), F.lit(""))


def declared_in_meta(body: Column) -> Column:
    """A meta element's charset within the first 1024 bytes, comments aside."""
    head = F.regexp_replace(F.decode(F.substring(body, 1, 1024), "ISO-8859-1"), r"(?s)<!--.*?(?:-->|$)", "")
    return F.nullif(F.regexp_extract(head, r"(?is)<meta[\s/][^>]*?charset\s*=\s*[\"']?\s*([^\s\"'/>;]+)", 1), F.lit(""))


def detect(content_type: Column, body: Column, html: bool = True) -> Column:
    """(encoding, provenance): the header's, else for HTML the page's own, else utf-8. A page that says UTF-16 is UTF-8."""
    header, meta = encoding_for(declared_in_header(content_type)), encoding_for(declared_in_meta(body))
    own = F.when(meta.startswith("utf-16"), F.lit("utf-8")).otherwise(meta) if html else F.lit(None).cast("string")
    return F.struct(F.coalesce(header, own, F.lit("utf-8")).alias("encoding"), F.when(header.isNotNull(), "header").when(own.isNotNull(), "meta").otherwise("default").alias("provenance"))


def _controls(error: UnicodeDecodeError) -> tuple[str, int]:
    """The web reads a byte that a Windows set leaves out as the control character of its number, if there is one."""
    byte = error.object[error.start]
    if 0x80 <= byte < 0xA0:
        return chr(byte), error.start + 1
    raise error


def _controls_or_sign(error: UnicodeDecodeError) -> tuple[str, int]:
    byte = error.object[error.start]
    return (chr(byte) if 0x80 <= byte < 0xA0 else "\ufffd"), error.start + 1


def decoded(body: bytes, label: str | None, fatal: bool = False, ignore_bom: bool = False) -> str | None:
    """Text of a body: a byte order mark wins over the label and goes, unless it is to be ignored, as text then; wrong bytes become
    replacement characters, or the whole body null if they are fatal. Null for an unknown label."""
    name = canonical(label)
    if name is None:
        return None
    if not ignore_bom:
        body, name = next(((body[len(mark) :], own) for mark, own in MARKS if body.startswith(mark)), (body, name))
    if name == "replacement":
        return "" if not body else None if fatal else "\ufffd"
    if name == "x-user-defined":
        return "".join(chr(b if b < 128 else 0xF700 + b) for b in body)
    codecs.register_error("web", _controls)
    codecs.register_error("web-replace", _controls_or_sign)
    single = name.startswith("windows-")
    try:
        return body.decode(CODECS.get(name, name), ("web" if single else "strict") if fatal else "web-replace" if single else "replace")
    except UnicodeDecodeError:
        return None


#: Bodies that are decoded at a time: Python holds an Arrow batch and the texts of so many.
AT_A_TIME = 64


def _texts(columns: list[pa.Array]) -> pa.Array:
    return pa.array([None if b is None else decoded(b, e or "utf-8", bool(f), bool(i)) for b, e, f, i in zip(*(c.to_pylist() for c in columns), strict=True)], pa.string())


@arrow_udf(StringType())
def _decode(body: pa.Array, encoding: pa.Array, fatal: pa.Array, ignore_bom: pa.Array) -> pa.Array:
    columns = [body, encoding, fatal, ignore_bom]
    parts = [_texts([c.slice(i, AT_A_TIME) for c in columns]) for i in range(0, len(body), AT_A_TIME)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def decode(body: Column, encoding: Column, fatal: Column | None = None, ignore_bom: Column | None = None) -> Column:
    """decoded() of each row; a null encoding is utf-8."""
    no = F.lit(False)
    return _decode(body, encoding, no if fatal is None else fatal, no if ignore_bom is None else ignore_bom)


def with_text(rows: DataFrame, body: Column, encoding: Column, fatal: Column | None = None, ignore_bom: Column | None = None, text: str = "text") -> DataFrame:
    """rows with the text of decode(); a task hands on some texts at a time, so it holds one batch of bodies and those, however many there are."""
    no = F.lit(False)
    asked = [body, encoding, no if fatal is None else fatal, no if ignore_bom is None else ignore_bom]
    held = rows.select("*", *(c.alias(f"__{k}") for k, c in enumerate(asked)))
    schema = StructType([*rows.schema, StructField(text, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(i, AT_A_TIME)
                yield pa.RecordBatch.from_arrays([*part.columns[:-4], _texts(part.columns[-4:])], schema.names)

    return held.mapInArrow(run, schema)


@pandas_udf(StringType())
def encode_query(query: pd.Series, encoding: pd.Series, special: pd.Series) -> pd.Series:
    """A query in percent escapes of an encoding; characters it lacks become escaped numeric references."""

    def one(text: str, name: str, is_special: bool) -> str:
        keep = set(map(ord, "!$%&()*+,-./:;=?@[\\]^_`{|}~")) | ({ord("'")} if not is_special else set())
        out = []
        for c in text:
            try:
                raw = c.encode(CODECS.get(name, name) if name != "big5" else "big5")
            except UnicodeEncodeError:
                out.append(f"%26%23{ord(c)}%3B")
                continue
            out += [chr(b) if ord(c) < 128 and (chr(b).isalnum() or b in keep) else f"%{b:02X}" for b in raw]
        return "".join(out)

    return pd.Series([None if q is None else one(q, canonical(e) or "utf-8", bool(s)) for q, e, s in zip(query, encoding, special, strict=True)])
