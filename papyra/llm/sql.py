"""What several of the DuckDB queries need and DuckDB lacks."""


def crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text expression."""
    byte = "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::ubigint[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::ubigint))"
    codes = f"list_transform(regexp_extract_all({text}, '.'), lambda c: ord(c)::ubigint)"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {codes}), {byte}), 4294967295::ubigint)"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    """SQL for the words of a text: A-Z lower-cased, split at ASCII white space."""
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"
