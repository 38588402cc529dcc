"""Device columns from a user agent."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.config import DEFAULT, Config


@dataclass(frozen=True)
class AgentRule:
    """First rule whose pattern is found in the user agent wins."""

    pattern: str
    value: str
    brand: str | None = None
    model: str | None = None
    version: str | None = None  # pattern with one group


# A small rule set of our own; a full user-agent database can be passed instead.
BOTS = AgentRule(r"(?i)bot|crawl|spider|slurp", "Spider")
DEVICES = (
    AgentRule(r"iPad", "iPad", "Apple", "iPad"),
    AgentRule(r"iPhone", "iPhone", "Apple", "iPhone"),
    AgentRule(r"iPod", "iPod", "Apple", "iPod"),
    AgentRule(r"SM-[A-Z0-9]+|Samsung", "Samsung", "Samsung"),
    AgentRule(r"Pixel", "Pixel", "Google"),
    AgentRule(r"Macintosh", "Mac", "Apple", "Mac"),
)
BROWSERS = (
    AgentRule(r"Edg(?:e|A|iOS)?/", "Edge", version=r"Edg(?:e|A|iOS)?/([\d.]+)"),
    AgentRule(r"OPR/", "Opera", version=r"OPR/([\d.]+)"),
    AgentRule(r"Firefox/|FxiOS/", "Firefox", version=r"(?:Firefox|FxiOS)/([\d.]+)"),
    AgentRule(r"Chrome/|CriOS/", "Chrome", version=r"(?:Chrome|CriOS)/([\d.]+)"),
    AgentRule(r"(?:iPhone|iPad|iPod).*Safari/", "Mobile Safari", version=r"Version/([\d.]+)"),
    AgentRule(r"Safari/", "Safari", version=r"Version/([\d.]+)"),
)
SYSTEMS = (
    AgentRule(r"iPhone|iPad|iPod", "iOS", version=r"OS (\d+(?:[_.]\d+)*) like Mac"),
    AgentRule(r"Android", "Android", version=r"Android ([\d.]+)"),
    AgentRule(r"Windows", "Windows", version=r"Windows NT ([\d.]+)"),
    AgentRule(r"Mac OS X", "Mac OS X", version=r"Mac OS X (\d+(?:[_.]\d+)*)"),
    AgentRule(r"CrOS", "Chrome OS"),
    AgentRule(r"Linux", "Linux"),
)


def _number(agent: Column, rules: Sequence[AgentRule]) -> Column:
    """Number of the first matching rule, from 1; one more than the last if none."""
    out = F
    for number, rule in enumerate(rules, 1):
        out = out.when(agent.rlike(rule.pattern), number)
    last = F.lit(len(rules) + 1)
    return last if out is F else out.otherwise(last)


def _value(number: Column, values: Sequence[str | None], default: str | None) -> Column:
    listed = F.array(*[F.lit(v).cast("string") for v in (*values, default)])
    return F.element_at(listed, number)


def _version(agent: Column, number: Column, rules: Sequence[AgentRule]) -> Column:
    out, unknown = F, F.lit("0.0.0")
    for at, rule in enumerate(rules, 1):
        if rule.version is not None:
            found = F.nullif(F.regexp_extract(agent, rule.version, 1), F.lit(""))
            out = out.when(number == at, F.coalesce(F.translate(found, "_", "."), unknown))
    return unknown if out is F else out.otherwise(unknown)


def parse_agent(
    user_agent: Column,
    devices: Sequence[AgentRule] = DEVICES,
    browsers: Sequence[AgentRule] = BROWSERS,
    systems: Sequence[AgentRule] = SYSTEMS,
) -> Column:
    """The ``device`` struct of an event, by ordered rules.

    Each list is walked once.  Regex tests are a narrow projection: no join and no
    shuffle on the user agent, whose commonest value may cover a large part of the rows.
    """
    agent = F.coalesce(user_agent, F.lit(""))
    devices = (BOTS, *devices)
    numbers = F.struct(
        agent.alias("agent"),
        _number(agent, devices).alias("device"),
        _number(agent, browsers).alias("browser"),
        _number(agent, systems).alias("system"),
    )

    def found(n: Column) -> Column:
        return F.struct(
            _value(n["device"], [r.value for r in devices], "Other").alias("type"),
            _value(n["device"], [r.brand for r in devices], None).alias("brand"),
            _value(n["device"], [r.model for r in devices], None).alias("model"),
            _value(n["browser"], [r.value for r in browsers], "Other").alias("browser"),
            _version(n["agent"], n["browser"], browsers).alias("browser_version"),
            _value(n["system"], [r.value for r in systems], "Other").alias("os"),
            _version(n["agent"], n["system"], systems).alias("os_version"),
            (n["device"] == 1).alias("is_bot"),
        )

    # bound as a lambda variable, so the numbers are found once for all fields
    return F.get(F.transform(F.array(numbers), found), F.lit(0))


def flag_bots(device: Column, user_agent: Column, cfg: Config = DEFAULT) -> Column:
    """The device struct with ``is_bot`` also set by user agent.

    The collected flag stays as ``is_bot_old``.  An unknown user agent on a
    device not known to be a bot gives NULL, not FALSE.
    """
    kept = ("type", "brand", "model", "browser", "browser_version", "os", "os_version")
    bot = F.coalesce(device["is_bot"], F.lit(False)) | user_agent.rlike(cfg.bot_pattern)
    return F.struct(
        *[device[name].alias(name) for name in kept],
        bot.alias("is_bot"),
        device["is_bot"].alias("is_bot_old"),
    )
