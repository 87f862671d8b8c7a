"""Training-data operators over a table of documents: quality, sharding, secrets, rules, tokens,
toxicity, mixing, decontamination, personal data and near-duplicates. Nothing else imports this package.

Common to all operators: input columns are named by parameters, other columns may carry any name and are
either left out of the result or carried whole; a null text counts as empty; repeated rows are rows of
their own unless a docstring says otherwise; an empty table gives an empty result of the same schema.
"""
