"""Evaluation of labelled cohorts as Spark jobs: manifests, folds, vectors, retrieval, probes, resampling, reports."""
