from .plans.pipelines import main

main()
