"""Training-data operators: each module holds one operator, ``queries`` the registered queries.

Nothing outside this subpackage imports it, so it can be left out of a deployment.
"""
