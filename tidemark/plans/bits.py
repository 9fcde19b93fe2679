"""SQL of the check engine for the bytes of numbers."""


def little(value: str) -> str:
    """SQL: bytes of a BIGINT as hexadecimal text, the lowest byte first."""
    return f"array_to_string(list_reverse(regexp_extract_all(lpad(hex({value}), 16, '0'), '..')), '')"


def double(x: str) -> str:
    """SQL: the bits of a double that is finite, from its power of two and fraction."""
    size = f"(case when {x} <> 0 then abs({x}) end)"
    guess = f"cast(floor(log2({size})) as bigint)"
    power = f"greatest(-1022, {guess} + case when {size} < pow(2.0, {guess}) then -1 when {size} / 2 >= pow(2.0, {guess}) then 1 else 0 end)"
    half = f"({power} // 2)"
    scaled = f"{size} / pow(2.0, {half}) / pow(2.0, {power} - {half})"
    whole = f"coalesce(cast({scaled} * 4503599627370496 as bigint) + ({power} + 1022) * 4503599627370496, 0)"
    return f"({whole} + case when {x} < 0 then cast(-9223372036854775808 as bigint) else 0 end)"


DOUBLES = ["open", "high", "low", "close", "turnover"]


def column(name: str, prefix: str = "") -> str:
    """SQL: hexadecimal bytes of a bar's column, NULL for NULL."""
    x = prefix + name
    text = little(double(x) if name in DOUBLES else f"cast({x} as bigint)")
    return f"case when {x} is not null then {text} end"


def record(names: list[str]) -> str:
    """SQL: hexadecimal text of a packed record; NULL prices are the smallest double."""
    return "concat(" + ", ".join(f"coalesce({column(n)}, 'FFFFFFFFFFFFEFFF')" for n in names) + ")"
