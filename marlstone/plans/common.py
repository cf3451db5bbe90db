"""Pieces of SQL that several checks share."""

W = r"\p{L}\p{N}_"
SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sub(c: str, pattern: str, new: str = "''") -> str:
    return f"regexp_replace({c}, '{pattern}', {new}, 'g')"


def strip(c: str) -> str:
    return sub(c, f"^{SP}+|{SP}+$")


def tokens(c: str) -> str:
    cleaned = sub(f"lower({c})", r"[^\p{L}\p{N}_\s/\-.]", "' '")
    return rf"list_filter(string_split_regex({cleaned}, '\s+'), lambda t: t <> '')"


def found(c: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({c}, '{pattern}', {group}), '')"


def unit(c: str) -> str:
    """A vector at unit length in double."""
    v = f"{c}::double[]"
    return f"case when list_dot_product({v}, {v}) = 0 then {v} else list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v}))) end"
