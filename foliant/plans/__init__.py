"""The registered queries and their SQL, by domain."""

from foliant.plans import analytics, dates, documents, exchange, fanned, flows, forms, identities, measures, nested, outputs, privacy, records, recordsets, refinements, spans, streams, structure, texts, trees, versions

MODULES = (documents, dates, texts, privacy, identities, structure, measures, nested, trees, versions, outputs, forms, refinements, records, recordsets, spans, fanned, exchange, flows, analytics, streams)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
