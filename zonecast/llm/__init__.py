"""Operators for preparing language-model training data, one module each:

``packing`` (1), ``substring_dedup`` (2), ``mixing`` (3), ``block_search`` (4), ``jaccard_join`` (5),
``record_files`` (6), ``html_layout`` (7), ``bloom_lm`` (8), ``line_spread`` (9), ``quality_llr`` (10),
``filter_audit`` (11), ``prefix_trie`` (12), ``decontamination`` (13).
``queries`` registers one query per operator; ``corpus_pipeline.py`` at the repository top chains five.

Conventions shared by all operators:

* They read only the columns they name, so extra or clashing columns are harmless.
* A NULL text counts as empty; a NULL id is carried through, never dropped.
* Intermediate tables go to the shared folder of ``spark.checkpoint.dir`` (``zonecast.session``).
"""
