import re

from lithogrid.llm import license_scan as L

TEXTS = [
    None, "", "  ", "x", "The MIT License. MIT license", "mit  license", "mit-license apache\nLICENSE, version 2",
    "general public license", "Licensed under the GNU General Public License, version 3.",
    "mit licenses and amit license", "Licensed under CC BY-NC 4.0.", "cc by", "licensed under cc by sa 4",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this Software",
    "Permission is hereby denied, free of charge, to any person obtaining a copy of this Software",
    "ÀMIT licensé mit license é", "!!mit license!!", "İmit license mitKicense", "mit license " * 5000,
    "all rights reserved " + "word " * 3000 + "Released under the MIT license.",
    "license mit license general public license apache license",
]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base = [], set()
    for phrase, name in L.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        base |= {name} if at else set()
    own, share = set(), 0.0
    for name, statement, phrases in L.TEMPLATES:
        t = statement.split()
        posted = [(p, w) for p, w in enumerate(t) if w not in L.COMMON]
        key = set()
        for phrase in phrases:
            k = phrase.split()
            s = next(i for i in range(len(t)) if t[i:i + len(k)] == k)
            key |= {p for p in range(s, s + len(k)) if t[p] not in L.COMMON}
        for start in range(len(words)):
            on = {p for p, w in posted if start + p < len(words) and words[start + p] == w}
            if key <= on and len(on) >= L.ENOUGH * len(posted):
                own.add(name)
                share = max(share, len(on) / len(posted))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | own)), max(share, 0.5 if places else 0.0))


def test_matches_brute_force(docs_of):
    rows = [*enumerate(TEXTS), (None, "mit license"), (3, "x")]
    got = L.license_scan(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert sorted(map(repr, (tuple(r)[:8] for r in got))) == sorted(repr((i, *brute(t))) for i, t in rows)


def test_labels_do_not_depend_on_other_texts(docs_of):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r.labels for r in L.license_scan(docs_of(rows)).collect()}
    assert got == {i: brute(t)[5] for i, t in rows}
    # other texts move the anchors, not the labels
    more = [(100 + i, w) for i in range(3) for w in L.license_word_list()[i::3] * 3]
    moved = {r.doc_id: r.labels for r in L.license_scan(docs_of(rows + more)).collect()}
    assert all(moved[i] == got[i] for i in got)


def test_empty_table(docs_of):
    assert L.license_scan(docs_of([])).count() == 0


def test_production_settings_lose_no_license(docs_of):
    every = ". ".join(statement for _, statement, _ in L.TEMPLATES)
    want = sorted({label for label, *_ in L.TEMPLATES})
    titles = {1: ("GNU Lesser General Public License version 3", "gpl,lgpl", 0.5),
              2: ("GNU Affero General Public License", "agpl,gpl", 0.5), 3: ("Mozilla Public License", "mpl", 0.5),
              4: ("Foo bar baz Mozilla Public License", "mpl", 0.5)}
    rows = [(0, every), *((i, t) for i, (t, *_) in titles.items())]
    got = {r.doc_id: r for r in L.license_scan(docs_of(rows)).collect()}
    assert got[0].labels.split(",") == want
    assert got[0].labels == brute(every)[5]
    assert {i: (got[i].labels, got[i].score) for i in titles} == {i: t[1:] for i, t in titles.items()}


def test_every_word_of_a_key_phrase_is_mandatory(docs_of):
    texts = {
        1: ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa"), 2: ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"),
        3: ("Licensed under CC BY-ND 4.0", "cc-by,cc-by-nd"), 4: ("Licensed under CC BY 4.0", "cc-by"),
        5: ("Licensed under CC terms", ""), 6: ("no rights reserved", ""), 7: ("all rights reserved", "proprietary"),
        8: ("Permission was hereby granted, free of charge, to any person obtaining a copy of this Software", ""),
        9: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this Software", "mit"),
        10: ("Redistribution or use in source and binary forms, with or without modification, are permitted", ""),
        11: ("Permission to use, copy, modify, and or distribute this software for no purpose with or without fee", "")}
    got = {r.doc_id: r.labels for r in L.license_scan(docs_of([(i, t) for i, (t, _) in texts.items()])).collect()}
    assert got == {i: labels for i, (_, labels) in texts.items()}
