"""Operators of a training-data pipeline: decontamination, language-model scores, quality, token counts,
near-duplicates, secrets, toxicity, licences, subword pieces and shards. Nothing else in the library imports them."""
