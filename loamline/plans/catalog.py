"""All registered queries of the library proper, each with the SQL that gives the same rows."""

from . import bank, curation, evaluation, hierarchies, replies, samples, scans, statistics, streams, texts, training

PARTS = (samples, curation, texts, hierarchies, statistics, training, bank, evaluation, scans, streams, replies)
QUERIES: dict = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES: dict = {k: v for p in PARTS for k, v in p.ORACLES.items()}
