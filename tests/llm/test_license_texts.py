"""Every template is found where it stands, and nothing else with it."""

import re

from trajlytics.llm import licenses

from llm_text import prose


def test_each_template_is_told_from_the_others(docs_of):
    names = list(licenses.TEMPLATES)
    rows = [(k, prose(k, 40) + "\n" + licenses.TEMPLATES[n].upper() + "\n" + prose(k + 1, 40)) for k, n in enumerate(names)]
    rows += [(100 + k, prose(k, 40) + " " + licenses.TEMPLATES[n].replace(" ", "\n * ")) for k, n in enumerate(names)] + [(900, prose(5, 200))]
    got = {(r["doc_id"], r["template"]) for r in licenses.scan(docs_of(rows)).collect()}
    plain = {n: " ".join(re.findall(r"[a-z0-9]+", t.lower())) for n, t in licenses.TEMPLATES.items()}
    holds = lambda whole: [n for n in names if plain[n] in plain[whole]]  # noqa: E731  the header of one holds the notice of the same
    assert got == {(base + k, part) for base in (0, 100) for k, n in enumerate(names) for part in holds(n)}
