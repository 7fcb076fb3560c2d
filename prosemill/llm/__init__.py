"""Training-data operators: each module holds one operator, its query and (where SQL can say it) its oracle."""
