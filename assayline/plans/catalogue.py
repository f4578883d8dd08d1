"""Named queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from assayline.plans import cards, cells, intake, matching, publishing, reports, tables  # noqa: F401  (each registers its queries)

QUERIES = {**matching.QUERIES}
ORACLES = {**matching.ORACLES}
