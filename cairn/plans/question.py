"""A question as a plan, and a plan as a query: the deterministic planner and the executor."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from cairn.functions.fields import NEEDS
from cairn.operators import centers as center_ops
from cairn.operators import search

_STATUS = [("fallecid", "fallecido"), ("muert", "fallecido"), ("herid", "herido"), ("hospital", "ingresado"), ("ingresad", "ingresado"), ("desaparecid", "por_localizar"), ("por localizar", "por_localizar"), ("buscan", "por_localizar"), ("encontrad", "localizado"), ("localizad", "localizado"), ("a salvo", "localizado")]
_CENTER = re.compile(r"\b(centros?|acopio|refugios?|albergues?|donde (?:dono|llevo|donar)|donar|necesitan)\b")
_SMALL = set("a al busco como con cuantas cuantos de del donde el en es esta estan estas este hay la las lo los me mi para por que quien quienes se sobre son su un una y".split())
_TALK = re.compile(r"\b(persona|personas|gente|llamad[oa]s?|nombre|apellido|cedula|ci|informacion|saber|necesito|favor|alguien|encuentra|encuentran|estado)\b")


@dataclass
class Plan:
    tool: str = "persons"
    ci: str = ""
    name: str = ""
    status: str = ""
    municipality: str = ""
    need: str = ""


def plan(question: str) -> Plan:
    """Rules in order: a number, a center's words, a status, 'en <Place>', and the words left are the name."""
    low = question.lower().translate(str.maketrans("áéíóúüñ", "aeiouun"))
    out = Plan()
    if m := re.search(r"(?<![\d.])\d{1,2}[.\s]?\d{3}[.\s]?\d{3}(?![\d.])|\d{6,9}", low):
        out.ci = re.sub(r"\D", "", m.group(0))
    place = re.search(r"\ben (?:el |la |los |las )?([A-ZÁÉÍÓÚÑ][\wáéíóúüñ]+(?: (?:de |la |del )*[A-ZÁÉÍÓÚÑ][\wáéíóúüñ]+)*)", question)
    if place:
        out.municipality = place.group(1)
        low = low.replace(place.group(0).lower().translate(str.maketrans("áéíóúüñ", "aeiouun")), " ")
    if _CENTER.search(low) and not out.ci:
        out.tool = "centers"
        out.need = next((tag for tag, words in NEEDS if any(w in low for w in words)), "")
        return out
    for part, label in _STATUS:
        if part in low:
            out.status = label
            low = re.sub(rf"\S*{part}\S*", " ", low)
            break
    if not out.ci:
        words = [w for w in re.findall(r"[a-z]+", _TALK.sub(" ", low)) if w not in _SMALL]
        out.name = " ".join(words)
    return out


def answer(question: str, persons: DataFrame, centers: DataFrame, planner: Callable[[str], Plan] = plan) -> tuple[Plan, DataFrame]:
    """The plan and the rows it finds. ``planner`` may be a model; if it fails, the question is the name."""
    try:
        p = planner(question)
    except Exception:  # noqa: BLE001  a planner is foreign code
        p = Plan(name=question)
    if p.tool == "centers":
        return p, center_ops.search(centers, municipality=p.municipality or None, need=p.need or None, limit=8)
    given = {k: v for k, v in asdict(p).items() if k in ("ci", "name", "status", "municipality") and v}
    return p, search.for_question(persons, **given)
