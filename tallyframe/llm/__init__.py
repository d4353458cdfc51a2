"""Training-data operators for corpora of text documents, run as Spark jobs.

The rest of the library imports nothing from here; deleting this folder (and
``corpus_pipeline.py``) leaves everything else working.
"""
