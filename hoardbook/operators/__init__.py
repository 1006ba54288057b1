"""DataFrame-to-DataFrame operators. Only imports and grading histories write, to stage what they
read repeatedly."""
