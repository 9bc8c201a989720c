"""colloquy: evaluation of question-and-answer dialogues against weighted
label lists, written as Spark DataFrame / SQL plans.

Sub-packages
------------
functions   Column -> Column helpers (text rendering, reply parsing, scrub rules)
operators   DataFrame -> DataFrame operators (dialogues, labels, scoring,
            requests, diagnosis, metrics, joins)
sources     readers and writers (legacy CSV/JSON layouts, stage tables)
streaming   resumable runs, batch and Structured Streaming
plans       test bindings over the driver tables and the query catalogue
"""

__version__ = "0.1.0"
