"""The sale contract over VARIANT: the first check that fails names the reason.

Types are told apart by ``schema_of_variant``, never by a cast: ``true``, ``2.0`` and ``2`` all cast to a bigint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import parse_iso

#: Fixed values of the contract.
SUPPORTED_VERSIONS = (1, 2)
CURRENT_VERSION = 2
SALE_EVENT = "sale.confirmed"
PAYMENTS = ("cash", "card", "qr", "transfer")
REQUIRED = ("schema_version", "event_id", "event_type", "event_time", "key", "payload")
REQUIRED_PAYLOAD = ("store_id", "pos_id", "ticket_id", "amount_gs", "items", "payment")
#: JSON texts that count as an empty payload.
_FALSY = ("null", "[]", '""', "0", "0.0", "-0", "false", "{}")



def parsed(value: Column) -> Column:
    """VARIANT of UTF-8 JSON bytes or text; null where it is neither."""
    return F.try_parse_json(F.try_validate_utf8(value.cast("string")))


def _field(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "variant")


def _kind(variant: Column) -> Column:
    return F.schema_of_variant(variant)


def _text(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "string")


def _missing(variant: Column, prefix: str, names: tuple[str, ...]) -> Column:
    """Comma list of absent fields in declaration order; a JSON null is present."""
    return F.concat_ws(",", *[F.when(_field(variant, f"{prefix}.{name}").isNull(), F.lit(name)) for name in names])


def _number(kind: Column) -> Column:
    return (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")


def _same(a: Column, b: Column) -> Column:
    """Equal JSON values: numbers by value, all others by type and text."""
    as_number = lambda x: F.try_variant_get(x, "$", "double")
    numbers = _number(_kind(a)) & _number(_kind(b)) & (as_number(a) == as_number(b))
    return numbers | ((_kind(a) == _kind(b)) & (F.to_json(a) == F.to_json(b)))


def checks(v: Column) -> list[tuple[str, Column, Column]]:
    """(reason, failing condition, detail) in the order of the contract, for a parsed value."""
    get = lambda path: _field(v, path)
    version, payload, amount, items = get("$.schema_version"), get("$.payload"), get("$.payload.amount_gs"), get("$.payload.items")
    missing, missing_payload = _missing(v, "$", REQUIRED), _missing(v, "$.payload", REQUIRED_PAYLOAD)
    shown = lambda x: F.to_json(x)
    amount_value = F.try_variant_get(v, "$.payload.amount_gs", "double")
    amount_fits = F.try_variant_get(v, "$.payload.amount_gs", "decimal(38,9)").try_cast("bigint").isNotNull()
    object_payload = _kind(payload).startswith("OBJECT<")
    return [
        ("json_invalido", v.isNull(), F.lit("invalid JSON or UTF-8")),
        ("no_es_objeto", ~_kind(v).startswith("OBJECT<"), F.lower(_kind(v))),
        ("campos_faltantes", missing != "", missing),
        ("version_no_soportada", (_kind(version) != "BIGINT") | ~F.try_variant_get(v, "$.schema_version", "bigint").isin(*SUPPORTED_VERSIONS), shown(version)),
        ("event_type_desconocido", (_kind(get("$.event_type")) != "STRING") | (_text(v, "$.event_type") != SALE_EVENT), _text(v, "$.event_type")),
        ("event_id_invalido", (_kind(get("$.event_id")) != "STRING") | (_text(v, "$.event_id") == ""), shown(get("$.event_id"))),
        ("event_time_invalido", (_kind(get("$.event_time")) != "STRING") | parse_iso(_text(v, "$.event_time")).isNull(), _text(v, "$.event_time")),
        ("payload_invalido", ~object_payload & ~shown(payload).isin(*_FALSY), F.lower(_kind(payload))),
        ("payload_incompleto", missing_payload != "", missing_payload),
        ("clave_inconsistente", ~_same(get("$.key"), get("$.payload.store_id")), F.concat(F.lit("key="), _text(v, "$.key"), F.lit(" store="), _text(v, "$.payload.store_id"))),
        ("monto_invalido", ~_number(_kind(amount)) | ~(amount_value > 0) | ~amount_fits, shown(amount)),
        ("items_invalido", (_kind(items) != "BIGINT") | (F.try_variant_get(v, "$.payload.items", "bigint") <= 0), shown(items)),
        ("metodo_pago_desconocido", (_kind(get("$.payload.payment")) != "STRING") | ~_text(v, "$.payload.payment").isin(*PAYMENTS), _text(v, "$.payload.payment")),
    ]


def reject(v: Column) -> Column:
    """struct(motivo, detalle) of the first failing check, null for a valid event."""
    whens = [(failing, F.struct(F.lit(reason).alias("motivo"), F.coalesce(detail, F.lit("")).alias("detalle"))) for reason, failing, detail in checks(v)]
    first = reduce(lambda chain, w: chain.when(F.coalesce(w[0], F.lit(True)), w[1]), whens[1:], F.when(whens[0][0], whens[0][1]))
    return first


def sale(v: Column) -> Column:
    """The typed event at the current schema version. Version 1 gets channel "store" and no produced_at where they are absent."""
    version = F.try_variant_get(v, "$.schema_version", "bigint")
    channel = F.when((version < 2) & _field(v, "$.payload.channel").isNull(), F.lit("store")).otherwise(_text(v, "$.payload.channel"))
    amount = F.coalesce(F.try_variant_get(v, "$.payload.amount_gs", "bigint"), F.try_variant_get(v, "$.payload.amount_gs", "decimal(38,9)").try_cast("bigint"))
    fields = {
        "event_id": _text(v, "$.event_id"),
        "event_time": parse_iso(_text(v, "$.event_time")),
        "event_time_text": _text(v, "$.event_time"),
        "key": _text(v, "$.key"),
        "store_id": _text(v, "$.payload.store_id"),
        "pos_id": _text(v, "$.payload.pos_id"),
        "ticket_id": _text(v, "$.payload.ticket_id"),
        "amount_gs": amount,
        "items": F.try_variant_get(v, "$.payload.items", "bigint"),
        "payment": _text(v, "$.payload.payment"),
        "channel": channel,
        "produced_at": _text(v, "$.produced_at"),
        "schema_version": F.lit(CURRENT_VERSION),
        "version_in": version,
    }
    return F.struct(*[column.alias(name) for name, column in fields.items()])
