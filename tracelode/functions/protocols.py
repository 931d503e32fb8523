"""Header fields of industrial protocols as SQL expressions over a hex text column.

A payload is turned to hex once (``with_hex``); every field is then a substring of
that text.  ``h`` and ``endian`` are column names or SQL fragments, so nothing
here runs per row in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the public protocol specifications.
MODBUS_DATA_FUNCTIONS = [0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x0F, 0x10, 0x14, 0x15, 0x16, 0x17]
ENIP_COMMANDS = [0x0002, 0x0003, 0x0004, 0x0005, 0x0006, 0x0063, 0x0064, 0x0065, 0x0066, 0x006F, 0x0070]
ENIP_DATA_COMMANDS = [0x006F, 0x0070]
ENIP_STATUS = [*range(0x00, 0x07), 0x64, 0x65, *range(0x69, 0x7D)]
ENIP_HEADER = 24
CIP_DATA_SERVICES = [0x0C, 0x0D, 0x4C, 0x4D, 0x52, 0x54, 0x56]
MMS_CONTEXT = "020103"
MMS_SCAN = 24


def with_hex(df: DataFrame, payload: str = "payload", name: str = "h") -> DataFrame:
    return df.withColumn(name, F.hex(payload))


def _list(values) -> str:
    return "(" + ", ".join(str(v) for v in values) + ")"


def size(h: str) -> str:
    return f"(length({h}) div 2)"


def piece(h: str, at, width) -> str:
    return f"substr({h}, cast(2 * ({at}) + 1 as int), cast(2 * ({width}) as int))"


def num(h: str, at, width: int, endian: str = "'big'") -> str:
    """Unsigned number; ``endian`` is a SQL literal or a column."""
    straight = piece(h, at, width)
    if width == 1 or endian == "'big'":
        text = straight
    else:
        flipped = "concat(" + ", ".join(piece(h, f"{at} + {i}", 1) for i in reversed(range(width))) + ")"
        text = flipped if endian == "'little'" else f"if({endian} = 'little', {flipped}, {straight})"
    return f"cast(conv({text}, 16, 10) as bigint)"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def modbus_header(h: str) -> Column:
    """MBAP header and function code; null when the header is incomplete."""
    code = num(h, 7, 1)
    return F.expr(
        f"""if({size(h)} >= 7, named_struct(
        'transaction_id', {num(h, 0, 2)}, 'protocol_id', {num(h, 2, 2)}, 'length', {num(h, 4, 2)}, 'unit_id', {num(h, 6, 1)},
        'function_code', {code}, 'is_exception', coalesce({code} >= 128, false),
        'is_data_function', coalesce({code} in {_list(MODBUS_DATA_FUNCTIONS)}, false), 'is_valid', {piece(h, 2, 2)} = '0000'), null)"""
    )


def modbus_data(h: str, header: str) -> Column:
    """Hex after the header (and after the function code of data functions)."""
    skip = f"if({header}.is_data_function and {size(h)} > 8, 8, 7)"
    return F.expr(f"if({header}.is_valid and {size(h)} > 7, substr({h}, 2 * {skip} + 1), null)")


def modbus_rtu(h: str) -> Column:
    """Serial frame: unit, function, data and little-endian CRC."""
    code, n = num(h, 1, 1), size(h)
    return F.expr(
        f"""if({n} >= 4, named_struct('unit_id', {num(h, 0, 1)}, 'function_code', {code}, 'is_exception', {code} >= 128,
        'is_data_function', {code} in {_list(MODBUS_DATA_FUNCTIONS)}, 'data_hex', {piece(h, 2, f'{n} - 4')},
        'crc', {num(h, f'{n} - 2', 2, "'little'")}, 'frame_length', {n}), null)"""
    )


def enip_endianness(h: str) -> Column:
    """'big' or 'little' by votes over command, length and status; ties are big."""

    def votes(endian: str) -> str:
        fields = f"named_struct('c', {num(h, 0, 2, endian)}, 'n', {num(h, 2, 2, endian)}, 's', {num(h, 8, 4, endian)})"
        return let(
            fields,
            "v",
            f"if(v.c in {_list(ENIP_COMMANDS)}, 2, 0) + if(v.c in {_list(ENIP_DATA_COMMANDS)}, 1, 0) "
            f"+ if(v.n <= 1024, 1, 0) + if(v.s in {_list(ENIP_STATUS)}, 2, 0)",
        )

    return F.expr(f"""if({size(h)} >= 12, if({votes("'big'")} >= {votes("'little'")}, 'big', 'little'), null)""")


def enip_header(h: str, endian: str) -> Column:
    return F.expr(
        f"""if({size(h)} >= {ENIP_HEADER} and {endian} is not null, named_struct(
        'command', {num(h, 0, 2, endian)}, 'length', {num(h, 2, 2, endian)}, 'session_handle', {num(h, 4, 4, endian)},
        'status', {num(h, 8, 4, endian)}, 'sender_context', {piece(h, 12, 8)}, 'options', {num(h, 20, 4, endian)},
        'is_data_command', {num(h, 0, 2, endian)} in {_list(ENIP_DATA_COMMANDS)}, 'endianness', {endian}), null)"""
    )


def enip_body(h: str, header: str) -> Column:
    """Hex of the command-specific data when it is complete."""
    whole = f"{header}.length > 0 and {size(h)} >= {ENIP_HEADER} + {header}.length"
    return F.expr(f"if({whole}, {piece(h, ENIP_HEADER, f'{header}.length')}, null)")


def cpf_items(body: str, endian: str) -> Column:
    """Item walk of the common packet format.

    A fold over at most ``size / 4`` steps (an item takes at least four bytes); the
    first connected (0xB1) or unconnected (0xB2) item locates the CIP message."""
    n = size(body)
    count = num(body, 6, 2, endian)
    start = "named_struct('offset', 8L, 'seen', 0, 'cip_offset', cast(null as bigint), 'cip_length', cast(null as bigint), 'stop', false)"
    item = f"named_struct('kind', {num(body, 'a.offset', 2, endian)}, 'len', {num(body, 'a.offset + 2', 2, endian)})"
    take = "a.cip_offset is null and i.kind in (177, 178)"
    skip = "if(i.kind = 177, 2, 0)"
    moved = let(
        item,
        "i",
        f"""named_struct('offset', a.offset + 4 + i.len, 'seen', a.seen + 1,
        'cip_offset', if({take}, a.offset + 4 + {skip}, a.cip_offset), 'cip_length', if({take}, i.len - {skip}, a.cip_length),
        'stop', a.offset + 4 + i.len > {n})""",
    )
    walk = f"""aggregate(if(least({count}, {n} div 4) > 0, sequence(1L, least({count}, {n} div 4)), cast(array() as array<bigint>)),
        {start}, (a, x) -> if(a.stop or a.offset + 4 > {n}, a, {moved}))"""
    return F.expr(
        f"""if({n} >= 8, named_struct('interface_handle', {num(body, 0, 4, endian)}, 'timeout', {num(body, 4, 2, endian)},
        'item_count', {count}, 'walk', {walk}), null)"""
    )


def cip_header(body: str, cpf: str) -> Column:
    """Service, path and total header size of the located CIP message."""
    at = f"{cpf}.walk.cip_offset"
    message = piece(body, at, f"{cpf}.walk.cip_length")
    basic = f"(2 + 2 * {num('m', 1, 1)})"
    response = f"{num('m', 0, 1)} >= 128"
    header = f"if({response} and {size('m')} >= {basic} + 2, {basic} + 2 + 2 * {num('m', f'{basic} + 1', 1)}, {basic})"
    fields = f"""if({size('m')} >= 2 and {size('m')} >= {basic}, named_struct('service_code', {num('m', 0, 1)}, 'path_words', {num('m', 1, 1)},
        'is_response', {response}, 'is_data_service', {num('m', 0, 1)} % 128 in {_list(CIP_DATA_SERVICES)},
        'general_status', if({response}, {num('m', basic, 1)}, null), 'path_hex', {piece('m', 2, f'2 * {num("m", 1, 1)}')},
        'total_header_size', {at} + {header}), null)"""
    return F.expr(f"if({at} is not null, {let(message, 'm', fields)}, null)")


def cip_data(body: str, cip: str) -> Column:
    """Hex after all headers for services that carry data, else empty."""
    return F.expr(
        f"if({cip}.is_data_service and {size(body)} > {cip}.total_header_size, substr({body}, cast(2 * {cip}.total_header_size + 1 as int)), '')"
    )


def cip_path(path: str, endian: str) -> Column:
    """Class, instance and attribute ids of a request path (hex)."""
    n = size(path)
    start = "named_struct('at', 0, 'class_id', cast(null as bigint), 'instance_id', cast(null as bigint), 'attribute_id', cast(null as bigint), 'stop', false)"
    seg = let(
        num(path, "a.at", 1),
        "g",
        "named_struct('known', (g & 224) = 32 and (shiftright(g, 2) & 7) in (0, 1, 2), 'kind', shiftright(g, 2) & 7, 'form', g & 3)",
    )
    wide = "(s.known and s.form = 1)"
    bad = f"(s.known and (s.form > 1 or ({wide} and a.at + 3 >= {n})))"
    value = f"if({wide}, {num(path, 'a.at + 2', 2, endian)}, {num(path, 'a.at + 1', 1)})"

    def put(kind: int, name: str) -> str:
        return f"'{name}', if(s.known and s.kind = {kind} and not {bad}, {value}, a.{name})"

    moved = let(
        seg,
        "s",
        f"named_struct('at', a.at + if({wide}, 4, 2), {put(0, 'class_id')}, {put(1, 'instance_id')}, {put(2, 'attribute_id')}, 'stop', {bad})",
    )
    steps = f"if({n} >= 2, sequence(1, cast({n} div 2 as int)), cast(array() as array<int>))"
    return F.expr(f"aggregate({steps}, {start}, (a, x) -> if(a.stop or a.at + 1 >= {n}, a, {moved}))")


def mms_offsets(h: str) -> Column:
    """End of TPKT and COTP headers, end-of-transmission flag and the position of
    the service tag (searched in the next 24 bytes; -1 when absent)."""
    n = size(h)

    def after_length(at: str) -> str:
        first = num(h, at, 1)
        extra = f"if({first} < 128, 0, {first} - 128)"
        return f"if({extra} = 0 or {at} + 1 + {extra} <= {n}, {at} + 1 + {extra}, null)"

    inner = let(
        after_length("i + 1"),
        "p",
        f"if({piece(h, 'p', 1)} = '30', {let(after_length('p + 1'), 'q', 'q')}, null)",
    )
    tag = let(inner, "s", f"if({piece(h, 's', 3)} = '{MMS_CONTEXT}' and s + 3 < {n} and {num(h, 's + 3', 1)} >= 160, s + 3, null)")
    body = f"(5 + {num(h, 4, 1)})"
    scan = f"""array_min(transform(filter(sequence(b, least({n}, b + {MMS_SCAN}) - 1), i -> {piece(h, 'i', 1)} = '61'), i -> {tag}))"""
    eot = f"coalesce({piece(h, 5, 1)} = 'F0' and {num(h, 4, 1)} >= 2 and {num(h, 6, 1)} >= 128, false)"
    fields = f"named_struct('body', b, 'eot', {eot}, 'tag', if(b < {n}, coalesce({scan}, -1), -1))"
    return F.expr(f"if({n} >= 7 and {piece(h, 0, 1)} = '03' and {body} <= {n}, {let(body, 'b', fields)}, null)")


def mms_control_code(h: str, offsets: str) -> Column:
    tag = f"if({offsets}.tag >= 0, concat('0x', {piece(h, f'{offsets}.tag', 1)}), 'None')"
    return F.expr(f"if({offsets} is not null, concat(if({offsets}.eot, 'True', 'False'), ':', {tag}), null)")


def mms_data(h: str, offsets: str) -> Column:
    at = f"if({offsets}.tag >= 0, {offsets}.tag + 1, {offsets}.body)"
    return F.expr(f"if({offsets} is not null, substr({h}, cast(2 * {at} + 1 as int)), null)")


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    The one-element explode keeps the optimizer from inlining a costly expression
    into every place that reads a field of it."""
    return df.withColumn(name, F.explode(F.array(value)))


def enip_headers(df: DataFrame, payload: str = "payload", fixed_endian: str | None = None) -> DataFrame:
    """Only the header struct ``enip``; bodies, which cost most of :func:`parse`, are not walked."""
    return _enip_headed(df, payload, fixed_endian).drop("_h", "_e")


def _enip_headed(df: DataFrame, payload: str, fixed_endian: str | None) -> DataFrame:
    endian = F.lit(fixed_endian) if fixed_endian else enip_endianness("_h")
    return hold(hold(hold(df, "_h", F.hex(payload)), "_e", endian), "enip", enip_header("_h", "_e"))


def parse(df: DataFrame, protocol: str, payload: str = "payload", fixed_endian: str | None = None) -> DataFrame:
    """Header structs of one protocol plus ``control_code`` and ``data_hex``.

    Protocols are parsed in separate branches (``parse_all``), so a row pays only for
    its own protocol."""
    if protocol == "modbus":
        out = hold(df, "_h", F.hex(payload))
        out = out.withColumn("modbus", modbus_header("_h"))
        code = F.expr("if(modbus.function_code > 0, cast(modbus.function_code as string), null)")
        return out.withColumn("control_code", code).withColumn("data_hex", modbus_data("_h", "modbus")).drop("_h")
    if protocol == "enip":
        out = _enip_headed(df, payload, fixed_endian).withColumn("_b", enip_body("_h", "enip"))
        out = hold(out, "_b", F.expr("if(enip.is_data_command, _b, null)"))
        out = hold(hold(out, "cpf", cpf_items("_b", "_e")), "cip", cip_header("_b", "cpf"))
        code = F.expr(
            "concat('0x', lpad(hex(enip.command), 4, '0'), coalesce(concat(':0x', lpad(hex(cip.service_code), 2, '0')), ''))"
        )
        return out.withColumn("control_code", code).withColumn("data_hex", cip_data("_b", "cip")).drop("_h", "_b", "_e")
    if protocol == "mms":
        out = hold(hold(df, "_h", F.hex(payload)), "mms", mms_offsets("_h")).withColumn("control_code", mms_control_code("_h", "mms"))
        return out.withColumn("data_hex", mms_data("_h", "mms")).drop("_h")
    raise ValueError(f"unknown protocol {protocol!r}")


def parse_all(df: DataFrame, protocol: str, payload: str = "payload") -> DataFrame:
    """Control code and application bytes of mixed traffic, one branch per protocol."""
    parts = [
        parse(df.where(F.col(protocol) == name), name, payload).select(*df.columns, "control_code", "data_hex")
        for name in ("modbus", "enip", "mms")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
