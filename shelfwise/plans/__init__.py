"""The jobs: one module per group of reports, each job a function (Tables, params) -> DataFrame."""
