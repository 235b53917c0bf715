"""Every query of the library by name, with the SQL that states the same result."""

from inkspan.plans import frames, overlap, review, roundtrips, signals, style, tables, textstats
from inkspan.plans.dialect import register

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (overlap, textstats, signals, style, tables, review):
    register(QUERIES, ORACLES, _module.PLANS)
for _module in (frames, roundtrips):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
