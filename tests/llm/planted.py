"""Texts with planted personal data: sentences, names and numbers that the operator's lists were not written for."""

import random

KNOWN = "Anna Daniel Elena Marco Nadia Omar Paul Sofia Thomas Yuki".split()
UNKNOWN = "Torvald Ximena Bartholomew Ngozi Quentin Saoirse Zbigniew Ottilie Kwame Annelise".split()
SURNAMES = [a + b for a in ("Brand", "Hollo", "Kers", "Marl", "Penny", "Ravens", "Stav", "Thorn", "Wex") for b in ("berg", "croft", "ford", "mere", "stad", "well", "wick")]
STREETS = [a + b for a in ("Alder", "Birch", "Copper", "Dover", "Ferry", "Granite") for b in ("field", "gate", "moor", "side")]
FILLER = (
    "The build finished after the cache was cleared and the tests were run again.",
    "We moved the parser into its own folder, since two modules need it.",
    "Version 3.12.4 of the package drops the old flag; see commit 9f3c2d1 for why.",
    "Offsets 1024 to 4096 are read in one go, which takes 17 ms on the small machine.",
    "The bound is sharp for every even window and fails for the odd ones.",
    "Nothing else changed on 2024-03-18 except the name of the queue.",
    "Clone the mirror, then compare the tables row by row.",
)


def documents(n: int, seed: int) -> tuple[list[tuple[int, str]], set[tuple]]:
    """Rows (doc_id, text) and the planted (doc_id, kind, start, known given name)."""
    rnd = random.Random(seed)
    rows, truth = [], set()
    for k in range(n):
        text = ""
        for _ in range(rnd.randrange(2, 7)):
            text += rnd.choice(FILLER) + rnd.choice((" ", "\n"))
            if rnd.random() < 0.55:
                continue
            known = rnd.random() < 0.7
            given, sur = rnd.choice(KNOWN if known else UNKNOWN), rnd.choice(SURNAMES)
            mail = f"{given}.{sur}@{rnd.choice(('post', 'desk', 'lab'))}.{rnd.choice(('example', 'org', 'net'))}".lower()
            phone = rnd.choice((f"+44 20 {rnd.randrange(7000, 8000)} {rnd.randrange(1000, 9999)}", f"({rnd.randrange(201, 989)}) {rnd.randrange(201, 989)}-{rnd.randrange(1000, 9999)}", f"0{rnd.randrange(171, 179)} {rnd.randrange(1_000_000, 9_999_999)}"))
            ssn = f"{rnd.randrange(101, 665)}-{rnd.randrange(10, 99)}-{rnd.randrange(1000, 9999)}"
            street = f"{rnd.randrange(2, 180)} {rnd.choice(STREETS)} {rnd.choice(('Road', 'Street', 'Lane', 'Avenue'))}"
            kind, value, form = rnd.choice(
                (
                    ("person_name", f"{given} {sur}", rnd.choice(("Many thanks to {} for the patch.", "{} found the race and fixed it.", "As {} put it, the cache was cold.", "Reviewed by {} last week.", "The slides are from {}."))),
                    ("email", mail, rnd.choice(("Write to {} with questions.", "Replies go to {} only.", "See <{}>.", "The owner is {}, as before."))),
                    ("phone", phone, rnd.choice(("Call {} before noon.", "The desk answers on {}.", "Phone: {}", "Fax or ring {} in a hurry."))),
                    ("id_number", ssn, rnd.choice(("The form shows SSN {} in plain sight.", "Social security number {} was logged.", "He gave {} as his number."))),
                    ("street_address", street, rnd.choice(("Send it to {}, please.", "The office is at {} now.", "Deliver to {}."))),
                )
            )
            at = form.index("{}")
            truth.add((k, kind, len(text) + at, known or kind != "person_name"))
            text += form.format(value) + rnd.choice((" ", "\n"))
        rows.append((k, text))
    return rows, truth


def score(got: set[tuple], truth: set[tuple]) -> dict[str, tuple[int, float, float]]:
    """Per kind, names apart by whether the given name is on the list: planted, recall; and the precision of the kind."""
    out = {}
    kinds = sorted({(t[1], t[3]) for t in truth})
    for kind, known in kinds:
        mine = {t[:3] for t in truth if t[1] == kind and t[3] == known}
        found = {g for g in got if g[1] == kind}
        right = {t[:3] for t in truth if t[1] == kind}
        out[kind if known else f"{kind}, given name not listed"] = (len(mine), round(len(mine & got) / len(mine), 3), round(len(found & right) / max(1, len(found)), 3))
    return out
