"""Registered queries, one module per family (imported by ``plans.catalog``)."""
