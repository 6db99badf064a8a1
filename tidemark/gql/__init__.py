"""GraphQL over the tables of a database."""
