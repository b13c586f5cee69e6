"""Distributed operators: sequence, features, scaling, clustering, quantiles, sampling."""
