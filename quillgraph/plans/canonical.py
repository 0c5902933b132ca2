"""The canonical form of nested specifications: defaults filled, names canonical, every level sorted, each item with its path and a stable id.

Everything is a column expression over one row's nested arrays (schemas.SPEC): no shuffle, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json, canonical_token, hashed_id, path_segment

#: What a specification that is silent means (fixed values).
DEFAULTS = {"page": 100, "batch": 500, "cache": False, "delivery": "AT_LEAST_ONCE", "key": "requestId", "attempts": 3, "backoff": "EXPONENTIAL", "dlq": "default.dlq"}
TAGS = ("service", "boundedContext", "aggregate", "command")


def _sorted(items: Column, name: Callable[[Column], Column]) -> Column:
    """Items by their canonical name; equal names keep their order. Null: none."""
    keyed = F.transform(F.coalesce(items, F.array()), lambda x, i: F.struct(canonical_token(name(x)).alias("token"), i.alias("at"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def _named(items: Column) -> Column:
    return _sorted(items, lambda x: x["name"])


def _tokens(items: Column) -> Column:
    """The canonical names of an item list, in order."""
    return F.array_sort(F.transform(F.coalesce(items, F.array()), lambda x: canonical_token(x["name"])))


def _under(parent: Column, folder: str, name: Column) -> Column:
    return F.concat(parent, F.lit(f"/{folder}/"), path_segment(name))


def _item(kind: str, x: Column, parent: Column, folder: str, **facts: Column) -> list[Column]:
    """name, canonical_name, path and id of an item; facts are what its id depends on besides its kind, name and place."""
    token = canonical_token(x["name"])
    return [x["name"].alias("name"), token.alias("canonical_name"), _under(parent, folder, x["name"]).alias("path"), hashed_id(kind, token, parent, canonical_json(**facts)).alias("id")]


def _fields(items: Column, parent: Column) -> Column:
    flag = lambda c, silent: F.coalesce(c, F.lit(silent))
    one = lambda f: F.struct(*_item("field", f, parent, "fields", type=f["type"], pk=flag(f["pk"], False), nullable=flag(f["nullable"], True)), f["type"].alias("type"), flag(f["pk"], False).alias("pk"), flag(f["nullable"], True).alias("nullable"))
    return F.transform(_named(items), one)


def _entity(e: Column, parent: Column) -> Column:
    facts = {"table": e["table"], "fieldNames": _tokens(e["fields"])}
    return F.struct(*_item("entity", e, parent, "entities", **facts), e["table"].alias("table"), _fields(e["fields"], _under(parent, "entities", e["name"])).alias("fields"))


def _event(e: Column, parent: Column) -> Column:
    facts = {"topic": e["topic"], "schemaFormat": e["format"], "payload": _tokens(e["payload"])}
    return F.struct(*_item("event", e, parent, "events", **facts), e["topic"].alias("topic"), _fields(e["payload"], _under(parent, "events", e["name"])).alias("payload"))


def _event_path(key: Column, events: Column, parent: Column) -> Column:
    """The path of the last event, in canonical order, whose name or canonical name is the key, or else the key's canonical name; null if there is none."""

    def of(wanted: Column) -> Column:
        return F.try_element_at(F.filter(_named(events), lambda e: (e["name"] == wanted) | (canonical_token(e["name"]) == wanted)), F.lit(-1))["name"]

    found = F.coalesce(of(key), of(canonical_token(key)))
    return F.when(found.isNotNull(), _under(parent, "events", found))


def _command(x: Column, events: Column, parent: Column) -> Column:
    path = _under(parent, "commands", x["name"])
    emits = F.coalesce(x["emits"], F.array().cast("array<string>"))
    emitted = F.array_sort(F.filter(F.transform(emits, lambda e: _event_path(e, events, parent)), lambda p: p.isNotNull()))
    unknown = F.filter(emits, lambda e: _event_path(e, events, parent).isNull())
    ordered = _sorted(x["rules"], lambda r: r["id"])
    rule = lambda r: F.struct(r["id"].alias("name"), _under(path, "rules", r["id"]).alias("path"), hashed_id("rule", canonical_token(r["id"]), path, canonical_json(type=r["type"], source=r["ensure"])).alias("id"), r["type"].alias("type"), r["ensure"].alias("ensure"))
    facts = {"method": x["method"], "path": x["path"], "rules": F.transform(ordered, lambda r: r["id"]), "emits": emitted}
    return F.struct(
        *_item("command", x, parent, "commands", **facts), x["method"].alias("method"), x["path"].alias("url"), _fields(x["input"], F.concat(path, F.lit("/input"))).alias("input"),
        F.transform(ordered, rule).alias("rules"), emitted.alias("emits"), unknown.alias("unknown_emits"),
    )


def _machine(m: Column, parent: Column) -> Column:
    moves = F.transform(F.coalesce(m["transitions"], F.array()), lambda t, i: F.struct(t["on"].alias("on"), i.alias("at"), F.array_sort(t["from"]).alias("from"), t["to"].alias("to")))
    listed = F.transform(F.array_sort(moves), lambda t: F.struct(_under(parent, "commands", t["on"]).alias("command"), t["from"].alias("from"), t["to"].alias("to")))
    return F.when(m.isNotNull(), F.struct(m["name"].alias("name"), m["initial"].alias("initial"), F.array_sort(m["states"]).alias("states"), listed.alias("transitions")))


def _aggregate(a: Column, parent: Column) -> Column:
    path = _under(parent, "aggregates", a["name"])
    facts = {"identityField": a["identity"]["field"], "entityNames": _tokens(a["entities"]), "commandNames": _tokens(a["commands"]), "eventNames": _tokens(a["events"])}
    return F.struct(
        *_item("aggregate", a, parent, "aggregates", **facts), a["identity"].alias("identity"), F.transform(_named(a["entities"]), lambda e: _entity(e, path)).alias("entities"),
        _machine(a["machine"], path).alias("machine"), F.transform(_named(a["commands"]), lambda x: _command(x, a["events"], path)).alias("commands"), F.transform(_named(a["events"]), lambda e: _event(e, path)).alias("events"),
        F.transform(_named(a["hooks"]), lambda h: F.struct(h["name"].alias("name"), h["signature"].alias("signature"), F.coalesce(h["optional"], F.lit(False)).alias("optional"))).alias("hooks"),
    )


def _context(x: Column, parent: Column) -> Column:
    path = _under(parent, "bounded-contexts", x["name"])
    return F.struct(*_item("boundedContext", x, parent, "bounded-contexts", aggregateNames=_tokens(x["aggregates"])), F.transform(_named(x["aggregates"]), lambda a: _aggregate(a, path)).alias("aggregates"))


def canonical_specs(specs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Specifications (columns of schemas.SPEC) -> kept columns, settings, service and contexts, canonical; a row per row.

    Where messaging is given at all, its key and dead-letter queue stay as they are. A command's unknown events are listed in
    unknown_emits and left out of emits. Rules stay as texts; rules.rule_diagnostics() says which can't be read.
    """
    m, p = F.col("messaging"), F.col("performance")
    filled = lambda c, name: F.coalesce(c[name], F.lit(DEFAULTS[name])).alias(name)
    silent = lambda name: F.when(m.isNull(), DEFAULTS[name]).otherwise(m[name]).alias(name)
    settings = F.struct(
        F.coalesce("generation", F.lit(True)).alias("generation"), F.coalesce("external", F.lit(False)).alias("external"), filled(p, "page"), filled(p, "batch"), filled(p, "cache"),
        filled(m, "delivery"), silent("key"), filled(m, "attempts"), filled(m, "backoff"), silent("dlq"), F.coalesce("tags", F.array(*map(F.lit, TAGS))).alias("tags"),
    )
    name, package = F.col("service")["name"], F.col("service")["base_package"]
    path = F.concat(F.lit("/services/"), path_segment(name))
    service = F.struct(name.alias("name"), canonical_token(name).alias("canonical_name"), path.alias("path"), hashed_id("service", canonical_token(name), F.lit("/"), canonical_json(basePackage=package)).alias("id"))
    contexts = F.transform(_named(F.col("bounded_contexts")), lambda x: _context(x, path))
    return specs.select(*(keep or []), settings.alias("settings"), service.alias("service"), contexts.alias("contexts"))


def canonical_items(canonical: DataFrame) -> DataFrame:
    """(kind, id, path, canonical_name): a row per service, context, aggregate, entity, event, command and rule of canonical specifications."""
    row = lambda kind, x, name="canonical_name": F.struct(F.lit(kind).alias("kind"), x["id"].alias("id"), x["path"].alias("path"), x[name].alias("canonical_name"))
    each = lambda rows, kind: F.transform(rows, lambda x: row(kind, x))

    def of_aggregate(a: Column) -> Column:
        rules = F.flatten(F.transform(a["commands"], lambda x: F.transform(x["rules"], lambda r: row("rule", r, "name"))))
        fields = F.flatten(F.transform(a["entities"], lambda e: each(e["fields"], "field")))
        return F.concat(F.array(row("aggregate", a)), each(a["entities"], "entity"), fields, each(a["events"], "event"), each(a["commands"], "command"), rules)

    below = F.flatten(F.transform("contexts", lambda x: F.concat(F.array(row("boundedContext", x)), F.flatten(F.transform(x["aggregates"], of_aggregate)))))
    return canonical.select(F.inline(F.concat(F.array(row("service", F.col("service"))), below)))
