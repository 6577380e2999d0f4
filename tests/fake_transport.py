"""Stand-in for a provider: three pages of two records."""

import json


def fetch(query, cursor, size):
    page = 0 if cursor == "*" else int(cursor)
    if page >= 3:
        return [], cursor
    rows = [json.dumps({"title": f"{query} paper {page}-{i}", "doi": f"10.1/{page}{i}", "isOpenAccess": "Y",
                        "authorString": "Ada L, Bob M", "inPMC": "N"}) for i in range(min(size, 2))]
    return rows, str(page + 1)
