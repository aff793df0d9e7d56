"""The small labelled table for the personal-data model: sentences built by rule, each with its marked spans.

A sentence is a carrier with one slot; ``{}`` takes a value of the slot's kind. Carriers without a slot teach what is no
personal data (versions, dates, prices, tables, shouting). Values follow the formats in ``_value``; letters and digits
come from a fixed generator, so the table is the same everywhere.
"""

from __future__ import annotations

import random

KINDS = ("email", "ip", "card", "phone", "secret")

CARRIERS = {
    "email": ("write to {} for details", "{} is my address", "contact: {}", "sent by <{}>, yesterday", "mail ({}) or call", "from {}."),
    "ip": ("host {} did not answer", "{} logged in", "the server at {}, port open", "blocked {}.", "ping {} again and wait"),
    "card": ("card {} was charged", "pay with {} today", "number: {}, valid", "{} expired", "the account {}."),
    "phone": ("call {} now", "phone: {}", "{} is busy, try later", "reach us on {}.", "fax {}, office hours"),
    "secret": ("use {} to log in", "export {} before the run", "{} leaked", "token = {} here", "api key {}.", "it, {} of the"),
}
PLAIN = (
    "the cat sat on the mat and slept", "In 2019 we sold 1,250 units for $3.50 each.", "version 3.2.1 of the tool, released 12-05-2021",
    "name | price | stock | total | 42 | 17", "BUY!! NOW!! BEST!! OFFER!! 50%!!", "of%%% the&&& and*** to$$$ in###", "see section 4.2 (page 17) and table 3.",
    "room 101, floor 3, building B2", "a + b = c and x = 3.5 or y = -2", "e.g. this, i.e. that; etc.", "the score was 3:2 at 10:45 p.m.",
    "chapter IV - the end (part 2)", "key = value pairs, token ring, password rules", "la casa y el perro, él también.", "die Straße über dem Fluß; größer als je",
    "l'été à la plage, où êtes-vous ?", "GNU General Public License, version 3.", "All rights reserved. Copyright 2020 the authors", "100 200 300 400 500 600",
    "ISBN 978-3-16 and no. 12345", "http://example.org/en/12?page=2 is a page", "THE AND OF TO IN IS", "size 10x20x30, weight 5kg", "a_b_c and d-e-f or g/h", "+ 5 points, - 3 points, (7) left",
)
ROUNDS = 10


def _value(kind: str, r: random.Random) -> str:
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    if kind == "email":
        return f"{letters(r.randint(3, 8))}{r.choice(['', '.', '_'])}{r.choice(['', digits(2)])}{letters(r.randint(1, 3))}@{letters(r.randint(3, 7))}{r.choice(['', digits(1)])}.{r.choice(['com', 'example.com', 'org', 'co.uk', 'de'])}"
    if kind == "ip":
        return ".".join(str(r.randint(1, 255)) for _ in range(4))
    if kind == "card":
        return r.choice([digits(16), f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", digits(15)])
    if kind == "phone":
        return r.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"+{digits(11)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)}-{digits(3)}-{digits(4)}-{digits(3)}"])
    return r.choice([f"password={hexa(18)}", f'"{hexa(40)}"', "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), f"secret:{hexa(24)}", f"sk-{hexa(32)}", hexa(32)])


def labelled_table(seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(sentence, [(kind, start, end)]) rows."""
    r, rows = random.Random(seed), []
    for _ in range(ROUNDS):
        for kind, carriers in CARRIERS.items():
            for carrier in carriers:
                value = _value(kind, r)
                at = carrier.index("{}")
                rows.append((carrier.replace("{}", value), [(kind, at, at + len(value))]))
        rows += [(plain, []) for plain in PLAIN]
    return rows
