"""The registered queries: operators applied to the shared tables, each with its SQL twin."""
