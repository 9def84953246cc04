"""Labelled findings in the manner of code, configuration and logs: written apart from those that the
network is trained on, with other words, layouts and forms."""

from __future__ import annotations

import base64
import hashlib
import random
import uuid

WORDS = (
    "the of and to in is was for that with as by at from his it an were are which this also be had first one their its new after but who not they have her she two been other when there all during into "
    "school time may years more most only over city some world would where later up such used many can state about national out known university united then made under between part system family company"
).split()
LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
MIXED = LOWER + LOWER.upper() + DIGITS


def labelled(count: int, seed: int) -> list[tuple[str, int, int, bool]]:
    """(text, start, end, whether that stretch is a secret)."""
    rng = random.Random(seed)
    some = lambda letters, n: "".join(rng.choices(letters, k=n))
    words = lambda n: " ".join(rng.choices(WORDS, k=n))
    name = lambda: rng.choice(WORDS[20:]) + rng.choice(["", "_" + rng.choice(WORDS[20:]), "-" + rng.choice(WORDS[20:])])
    digest = lambda kind: hashlib.new(kind, rng.randbytes(9)).hexdigest()
    b64 = lambda n: base64.b64encode(rng.randbytes(n)).decode()
    secrets = (
        ("export API_KEY=", lambda: some(MIXED, 32), "\n"),
        ('"client_secret": "', lambda: some(MIXED, 40), '",'),
        ("  password: ", lambda: some(MIXED, 14), "\n  port: 5432"),
        ("aws_access_key_id = ", lambda: "AKIA" + some(LOWER.upper() + DIGITS, 16), "\nregion = eu"),
        ("aws_secret_access_key = ", lambda: b64(30), "\n"),
        ("curl -H 'Authorization: Bearer ", lambda: some(MIXED + "-_", 44), "' "),
        ("token=", lambda: digest("sha1"), " "),
        ("auth_token: '", lambda: digest("md5"), "'"),
        ("git clone https://ci:", lambda: "ghp_" + some(MIXED, 36), "@example.org/x.git"),
        ("mysql://root:", lambda: some(MIXED, 12), "@db.internal:3306/app"),
        ("SECRET_KEY = '", lambda: some(MIXED + "+/=-_", 50), "'"),
        ("jdbc:x://db;user=sa;password=", lambda: some(LOWER, 5) + some(DIGITS, 4), ";"),
        ("slack ", lambda: f"xoxb-{some(DIGITS, 12)}-{some(MIXED, 24)}", " "),
        ("--private-key=", lambda: digest("sha256"), " --verbose"),
    )
    others = (
        ("commit ", lambda: digest("sha1"), "\nAuthor: someone"),
        ("sha256:", lambda: digest("sha256"), " pulled"),
        ("ETag: ", lambda: digest("md5"), "\n"),
        ("trace ", lambda: str(uuid.UUID(bytes=rng.randbytes(16))), " ended"),
        ("see /", lambda: "/".join(name() for _ in range(4)) + f"{rng.randint(1, 99)}.html", " for more"),
        ("card ", lambda: "4" + some(DIGITS, 15), " was charged"),
        ("ISBN ", lambda: "978" + some(DIGITS, 13), ", second edition"),
        ("in ", lambda: "".join(w.capitalize() for w in rng.choices(WORDS, k=7))[:40].ljust(20, "x"), "(self)"),
        ("get ", lambda: "-".join(rng.choices(WORDS, k=6)) + "-" + some(DIGITS, 4), ".zip"),
        ("password: ", lambda: rng.choice(["changeme", "<your-password>", "your_password_here", "xxxxxxxx", "example", "placeholder", "undefined"]), "\n"),
        ("at ", lambda: f"20{some(DIGITS, 2)}-1{rng.randint(0, 2)}-2{rng.randint(0, 8)}T1{some('0123456789', 1)}.30.15.000", " it began"),
        ("order ", lambda: some(DIGITS, 18), " has left"),
    )
    found = []
    for i in range(count):
        before, make, after = rng.choice(secrets if i % 2 else others)
        lead = words(rng.randint(4, 12)) + rng.choice([" ", "\n", ". "]) + before
        value = make()
        found.append((lead + value + after + " " + words(rng.randint(4, 12)), len(lead), len(lead) + len(value), bool(i % 2)))
    return found
