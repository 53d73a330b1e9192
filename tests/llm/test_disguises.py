"""Disguised identifiers planted in clean texts, by language and shape; digit names and signs are written out here, apart from the code's tables."""

from __future__ import annotations

import random

import pytest

from corvane.llm import pii

LANGUAGES = {
    "en": ("zero one two three four five six seven eight nine", "at", "dot", ("com", "org")),
    "de": ("null eins zwo drei vier fünf sechs sieben acht neun", "at", "punkt", ("de", "com")),
    "fr": ("zéro un deux trois quatre cinq six sept huit neuf", "at", "point", ("fr", "org")),
    "es": ("cero uno dos tres cuatro cinco seis siete ocho nueve", "arroba", "punto", ("es", "com")),
}
FILLER = {
    "en": "the old river runs past a quiet mill and nobody there minds the rain",
    "de": "der alte fluss fließt an einer mühle vorbei und niemand stört sich am regen",
    "fr": "la vieille rivière passe devant un moulin et un chien dort sous un arbre",
    "es": "el viejo río pasa junto a un molino y nadie se queja de la lluvia",
}


def planted(rng, lang, shape):
    names, at, dot, tops = LANGUAGES[lang]
    names = names.split()
    say = lambda digits, gap: gap.join(names[int(d)] for d in digits)
    if shape == "phone":
        digits = "".join(str(rng.randrange(10)) for _ in range(rng.randrange(9, 13)))
        return "phone", rng.choice(["+" + digits[:2] + " " + say(digits[2:], " "), "plus " + say(digits, rng.choice([" ", ", ", "-"]))])
    if shape == "ip":
        octets = [str(rng.randrange(256)) for _ in range(4)]
        return "ip", f" {dot} ".join(say(o, " ") if rng.random() < 0.5 else o for o in octets)
    user = rng.choice(["kmeier", "j.durand", "ana_lopez", "w-smith"]) + str(rng.randrange(99))
    host = rng.choice(["nordpost", "mailbox7", "correo-uno"])
    return "email", rng.choice([f"{user} {at} {host} {dot} {rng.choice(tops)}", f"{user} [{at}] {host} [{dot}] {rng.choice(tops)}", f"{user} ({at}) {host} ({dot}) {rng.choice(tops)}"])


@pytest.mark.parametrize("lang", LANGUAGES)
@pytest.mark.parametrize("shape", ["phone", "ip", "email"])
def test_planted(lang, shape):
    rng = random.Random(f"{lang}{shape}")
    words = FILLER[lang].split()
    hits = 0
    for _ in range(300):
        kind, body = planted(rng, lang, shape)
        k = rng.randrange(1, len(words))
        text = " ".join(words[:k]) + ": " + body + "; " + " ".join(words[k:])
        _, spans = pii.scan(text)
        hits += [(pii.KINDS[x], text[s:e]) for x, s, e in spans] == [(kind, body)]
    assert hits >= 297, hits


@pytest.mark.parametrize("lang", LANGUAGES)
def test_clean_texts_stay(lang):
    rng = random.Random(lang)
    names, at, dot, _ = LANGUAGES[lang]  # signs and names, but no address
    words = FILLER[lang].split() + names.split()[:4] + [rng.choice([at, dot]), "12", "3"]
    for _ in range(300):
        assert pii.scan(" ".join(rng.choice(words) for _ in range(30)))[1] == []
