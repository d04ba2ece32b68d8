"""RESP-2: encoding, decoding, command dispatch and display.

Encoding, dispatch and display are JVM expressions. Flat commands decode by
byte arithmetic in a fold; a buffer of several or nested values needs a parser
and goes through a table function, a buffer at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udf, udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

CRLF = "\r\n"
# The replies of the server.
REPLIES = {
    "format": "Invalid command format",
    "string": "Command must be a string",
    "set_arity": "SET command requires key and value arguments",
    "set_type": "SET command requires string arguments",
    "get_arity": "GET command requires a key argument",
    "get_type": "GET command requires a string key",
    "del_arity": "DEL command requires a key argument",
    "del_type": "DEL command requires a string key",
}


def bulk(value: Column) -> Column:
    """A bulk string, its length in bytes; null is the null bulk."""
    return F.when(value.isNull(), F.lit(f"$-1{CRLF}")).otherwise(F.concat(F.lit("$"), F.octet_length(value).cast("string"), F.lit(CRLF), value, F.lit(CRLF)))


def simple(value: Column) -> Column:
    return F.concat(F.lit("+"), value, F.lit(CRLF))


def error(value: Column) -> Column:
    return F.concat(F.lit("-"), value, F.lit(CRLF))


def integer(value: Column) -> Column:
    return F.concat(F.lit(":"), value.cast("string"), F.lit(CRLF))


def command(args: Column) -> Column:
    """An array of bulk strings; a null array is the null array."""
    body = F.array_join(F.transform(args, bulk), "")
    return F.when(args.isNull(), F.lit(f"*-1{CRLF}")).otherwise(F.concat(F.lit("*"), F.size(args).cast("string"), F.lit(CRLF), body))


def dispatch(args: Column, stored: Column) -> Column:
    """The reply to a command; ``stored`` is the live value of its key. Further arguments are ignored."""
    name, key, value, n = F.get(args, F.lit(0)), F.get(args, F.lit(1)), F.get(args, F.lit(2)), F.size(args)
    said = {k: error(F.lit(v)) for k, v in REPLIES.items()}
    upper = F.upper(name)
    return (
        F.when(args.isNull() | (n == 0), said["format"])
        .when(name.isNull(), said["string"])
        .when(upper == "SET", F.when(n < 3, said["set_arity"]).when(key.isNull() | value.isNull(), said["set_type"]).otherwise(simple(F.lit("OK"))))
        .when(upper == "GET", F.when(n < 2, said["get_arity"]).when(key.isNull(), said["get_type"]).otherwise(bulk(stored)))
        .when(upper == "DEL", F.when(n < 2, said["del_arity"]).when(key.isNull(), said["del_type"]).otherwise(integer(F.lit(1))))
        .otherwise(error(F.concat(F.lit("Unknown command: "), upper)))
    )


class Incomplete(Exception):
    """More bytes are needed."""


class Malformed(Exception):
    """No bytes to come can make this a value."""


def _line(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b"\r\n", at)
    if end < 0:
        raise Incomplete
    return data[at:end], end + 2


def _number(raw: bytes) -> int:
    """Leading blanks and a sign are accepted, and whatever follows the digits."""
    found = re.match(rb"[ \t\n\v\f\r]*([+-]?[0-9]+)", raw)
    if not found or not -(1 << 63) <= int(found[1]) < 1 << 63:
        raise Malformed
    return int(found[1])


def parse(data: bytes, at: int = 0) -> tuple[tuple, int]:
    """The value at a place, as (kind, content), and where it ends."""
    if at >= len(data):
        raise Incomplete
    kind = data[at : at + 1]
    if kind not in b"+-:$*":
        raise Malformed
    raw, at = _line(data, at + 1)
    if kind == b"+":
        return ("simple", raw.decode("utf-8", "replace")), at
    if kind == b"-":
        return ("error", raw.decode("utf-8", "replace")), at
    n = _number(raw)
    if kind == b":":
        return ("integer", n), at
    if n == -1:
        return ("bulk" if kind == b"$" else "array", None), at
    if n < 0:
        raise Malformed
    if kind == b"$":
        if at + n + 2 > len(data):
            raise Incomplete
        if data[at + n : at + n + 2] != b"\r\n":
            raise Malformed
        return ("bulk", data[at : at + n].decode("utf-8", "replace")), at + n + 2
    values = []
    for _ in range(n):
        value, at = parse(data, at)
        values.append(value)
    return ("array", values), at


def show(value: tuple) -> str:
    """How the client displays a value."""
    kind, content = value
    if kind == "simple":
        return content
    if kind == "error":
        return f"ERROR: {content}"
    if kind == "integer":
        return f"({content})"
    if kind == "bulk":
        return "NULL" if content is None else f'"{content}"'
    if content is None:
        return "NULL ARRAY"
    return f"Array[{len(content)}]:\n" + "".join(f"  {i}) {show(v)}\n" for i, v in enumerate(content))


def _strings(value: tuple) -> list | None:
    kind, content = value
    if kind != "array" or content is None:
        return None
    return [c if k in ("bulk", "simple") else None for k, c in content]


_DECODED = StructType([
    StructField("pos", IntegerType()), StructField("args", ArrayType(StringType())), StructField("kind", StringType()), StructField("shown", StringType()), StructField("consumed", LongType()), StructField("status", StringType()),
])


@udtf(returnType=_DECODED)
class Decode:
    """One row a value of a buffer, in order; a last row of status incomplete or malformed where parsing stops early."""

    def eval(self, data: str) -> Iterator[tuple]:
        raw, at, pos = (data or "").encode("utf-8"), 0, 0
        while at < len(raw):
            try:
                value, end = parse(raw, at)
            except (Incomplete, Malformed) as e:
                yield pos, None, None, None, at, type(e).__name__.lower()
                return
            yield pos, _strings(value), value[0], show(value), end, "ok"
            at, pos = end, pos + 1


@udf(ArrayType(StringType()))
def arguments(data: str) -> list | None:
    """The arguments of the first command of a buffer; null if there is none."""
    try:
        return _strings(parse((data or "").encode("utf-8"))[0])
    except (Incomplete, Malformed):
        return None


def flat_arguments(wire: Column, n: int) -> list[Column]:
    """The n bulk strings of a flat command, by byte arithmetic in the JVM; null where the command is something else."""
    data = F.encode(wire, "utf-8")
    head = F.concat(F.lit(f"*{n}"), F.lit(CRLF))
    at = F.octet_length(head)
    ok = wire.startswith(head)
    out = []
    for _ in range(n):
        tail = F.hex(F.substring(data, at + 1, F.lit(24)))
        digits = F.regexp_replace(F.regexp_extract(tail, "^24((?:3[0-9])+)0D0A", 1), "3([0-9])", "$1")
        size = digits.try_cast("int")
        start = at + F.length(digits) + 3
        ok = ok & size.isNotNull() & (start + size + 2 <= F.octet_length(data))
        out.append(F.when(ok, F.decode(F.substring(data, start + 1, size), "utf-8")))
        at = start + size + 2
    return out


def register(spark: SparkSession) -> None:
    """Makes ``resp_values(buffer)`` callable from SQL."""
    spark.udtf.register("resp_values", Decode)
