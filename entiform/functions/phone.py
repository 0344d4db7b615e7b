"""Phone standardisation from a small table of national numbering plans.

The plan table is a short tuple that is compiled into the expression, so no join is needed and the same
rule works on columns and inside arrays. Numbers of countries without a plan keep their international
form but are never valid and have no country.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from entiform.functions.names import literal_map
from entiform import fixed
from entiform.functions.text import BLANK, let, trim


class Plan(NamedTuple):
    iso2: str
    calling_code: str
    idd: str  # international prefix
    trunk: str  # national prefix, '' when there is none
    nsn: str  # pattern of a valid national number


# National numbering plans.
PLANS = (
    Plan("CM", "237", "00", "", "2(?:22|33|4[23])[0-9]{6}|6(?:[25-9][0-9]|40)[0-9]{6}|88[0-9]{6,7}"),
    Plan("CI", "225", "00", "", "[02][157][0-9]{8}"),
    Plan("SN", "221", "00", "", "3[039][0-9]{7}|7[0-35-8][0-9]{7}"),
    Plan("GA", "241", "00", "0", "[67][0-9]{7}|11[0-9]{6}"),
    Plan("BJ", "229", "00", "", "01[24-69][0-9]{7}"),
    Plan("TG", "228", "00", "", "2[2-7][0-9]{6}|7[019][0-9]{6}|9[0-36-9][0-9]{6}"),
    Plan("BF", "226", "00", "", "2[0-5][0-9]{6}|0[1-35-7][0-9]{6}|5[0-8][0-9]{6}|[67][0-9]{7}"),
    Plan("ML", "223", "00", "", "[24-9][0-9]{7}"),
    Plan("NG", "234", "009", "0", "(?:70|80|81|90|91)[0-9]{8}|[1-9][0-9]{6,7}"),
    Plan("US", "1", "011", "1", "[2-9][0-9]{2}[2-9][0-9]{6}"),
)

_SEPARATORS = "[ \u00a0\u00ad\u200b\u2060\u3000\u2010-\u2015\u2212()\\[\\]./~-]"


def first_chunk(raw: Column) -> Column:
    """A field may hold several numbers; the first one counts."""
    return trim(F.regexp_replace(raw, f"(?s)(?:[/;]|{BLANK}{{2,}}).*", ""))


def candidate(chunk: Column) -> Column:
    """Digits, with a leading + when written; NULL when the chunk is no phone number."""
    def digits(span: Column) -> Column:
        shaped = F.rlike(span, F.lit(f"^[+]?(?:{_SEPARATORS}*[0-9]){{2,}}$"))
        return F.when(shaped & (F.length(chunk) <= fixed.PHONE_MAX_TEXT), F.regexp_replace(span, "[^+0-9]", ""))

    span = F.regexp_extract(chunk, "(?s)[+0-9](?:.*[0-9])?", 0)
    return let(F.regexp_replace(span, "(?i)[ .,]*(?:;ext=|extn?[.]?|x|#)[ .:]*[0-9]{1,7}$", ""), digits)


def _keyed(iso: Column, number: Column) -> Column:
    """`ISO:number`, so that one pattern covers the rule of every plan."""
    return F.concat(iso, F.lit(":"), number)


def _per_plan(plans, rule) -> str:
    return "^(?:" + "|".join(f"{p.iso2}:{rule(p)}" for p in plans) + ")"


def international(number: Column, iso: Column, plans=PLANS) -> Column:
    """The international prefix of the caller's country becomes a +."""
    dialled = F.regexp_extract(_keyed(iso, number), _per_plan(plans, lambda p: p.idd) + "([1-9][0-9]*)$", 1)
    return F.when(F.length(dialled) > 0, F.concat(F.lit("+"), dialled)).otherwise(number)


def _by_code(plans) -> dict[str, str]:
    codes: dict[str, str] = {}
    for p in plans:
        codes.setdefault(p.calling_code, p.iso2)
    return codes


def located(number: Column, iso: Column, plans=PLANS) -> Column:
    """struct<plan, nsn, abroad, number>: the plan by calling code (longest first), else the caller's."""
    codes = sorted(_by_code(plans), key=len, reverse=True)
    code = F.regexp_extract(number, "^[+](" + "|".join(codes) + ")", 1)
    abroad = number.startswith("+")
    home = F.when(iso.isin(*[p.iso2 for p in plans]), iso)
    return F.struct(
        F.when(abroad, F.try_element_at(literal_map(_by_code(plans)), code)).otherwise(home).alias("plan"),
        F.when(abroad, F.substr(number, F.length(code) + 2)).otherwise(number).alias("nsn"),
        abroad.alias("abroad"), number.alias("number"))


def options(at: Column, plans=PLANS) -> Column:
    """The located number with its two shorter readings: without national prefix, without calling code."""
    whole = _keyed(at["plan"], at["nsn"])
    trunked = [p for p in plans if p.trunk]
    short = F.regexp_extract(whole, _per_plan(trunked, lambda p: p.trunk) + "(.+)$", 1) if trunked else F.lit("")
    bare = F.regexp_extract(whole, _per_plan(plans, lambda p: p.calling_code) + "(.+)$", 1)
    return F.struct(
        at["plan"].alias("plan"), at["nsn"].alias("nsn"), at["abroad"].alias("abroad"), at["number"].alias("number"),
        F.nullif(short, F.lit("")).alias("short"),
        F.when(~at["abroad"], F.nullif(bare, F.lit(""))).alias("bare"))


def judged(o: Column, plans=PLANS) -> Column:
    """Adds which readings are valid national numbers."""
    pattern = _per_plan(plans, lambda p: f"(?:{p.nsn})") + "$"

    def ok(field: str) -> Column:
        return F.coalesce(F.rlike(_keyed(o["plan"], o[field]), F.lit(pattern)), F.lit(False)).alias(f"{field}_ok")

    return F.struct(*[o[n].alias(n) for n in ("plan", "nsn", "abroad", "number", "short", "bare")],
                    ok("nsn"), ok("short"), ok("bare"))


def chosen(o: Column) -> Column:
    """struct<plan, abroad, number, body, ok>: the reading that counts.

    A national prefix goes unless that would make a valid number invalid; a calling code written without +
    goes only when that makes the number valid.
    """
    drop_trunk = o["short"].isNotNull() & (o["short_ok"] | ~o["nsn_ok"])
    drop_code = ~o["nsn_ok"] & o["bare_ok"]
    return F.struct(
        o["plan"].alias("plan"), o["abroad"].alias("abroad"), o["number"].alias("number"),
        F.when(drop_code, o["bare"]).when(drop_trunk, o["short"]).otherwise(o["nsn"]).alias("body"),
        F.when(drop_code, F.lit(True)).when(drop_trunk, o["short_ok"]).otherwise(o["nsn_ok"]).alias("ok"))


def resolved(c: Column, plans=PLANS) -> Column:
    """struct<e164, valid, country> of a chosen reading."""
    code = F.try_element_at(literal_map({p.iso2: p.calling_code for p in plans}), c["plan"])
    home = F.when(F.length(c["body"]).between(2, 17), F.concat(F.lit("+"), code, c["body"]))
    foreign = F.when(c["plan"].isNull() & c["abroad"] & F.length(c["number"]).between(4, 18), c["number"])
    e164 = F.coalesce(home, foreign)
    return F.struct(
        e164.alias("e164"), F.coalesce(home.isNotNull() & c["ok"], F.lit(False)).alias("valid"),
        F.when(home.isNotNull(), c["plan"]).alias("country"))


def _steps(iso: Column, plans):
    return (
        lambda c: international(c, iso, plans), lambda c: located(c, iso, plans), lambda c: options(c, plans),
        lambda c: judged(c, plans), chosen, lambda c: resolved(c, plans))


def standardize_phone(raw: Column, iso: Column, plans=PLANS) -> Column:
    """struct<e164, valid, country>.

    Every step is bound once: as plain projections the steps would be inlined into each other again.
    """
    def run(value: Column, steps) -> Column:
        return steps[0](value) if len(steps) == 1 else let(steps[0](value), lambda v: run(v, steps[1:]))

    return let(let(first_chunk(raw), candidate), lambda c: run(c, _steps(iso, plans)))
