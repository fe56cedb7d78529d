"""foilframe: card-image analytics and training-data operators as Spark jobs."""
